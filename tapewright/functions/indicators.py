"""The indicator set: bars in, bars and the chosen indicators' columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.native import NATIVE, apply, filled
from tapewright.functions.recursive import RECURSIVE, recursive_indicators
from tapewright.operators.blocks import BLOCK_ROWS, HALO_ROWS, blocked, finished
from tapewright.plans.dims import DEFAULT_SET

TREND = ("COMBINED_TREND", "COMBINED_TREND_SIGNAL", "TRD_ADX", "TRD_PLUS_DI", "TRD_MINUS_DI", "TRD_RSI")
LEAST_ROWS = 30
#: Indicators with a running sum: the sum and the column of its steps.
SUMMED = {"CVD": ("CVD", "CVD_Delta"), "OBV": ("OBV", "_obv_step")}


def trend(df: DataFrame) -> DataFrame:
    """The combined trend: a strong ADX with the DIs apart, and an RSI that leaves room. NO_SIGNAL while one of them is missing."""
    adx, plus, minus, strength = F.col("ADX"), F.col("`+DI`"), F.col("`-DI`"), F.col("RSI")
    missing = adx.isNull() | plus.isNull() | minus.isNull() | strength.isNull()
    strong = adx >= 25
    signal = F.when(missing, "NO_SIGNAL").when(strong & (plus - minus >= 5) & (strength < 65), "BUY").when(strong & (minus - plus >= 5) & (strength > 35), "SELL").otherwise("WAIT")
    df = df.withColumns({"COMBINED_TREND_SIGNAL": signal, "TRD_ADX": adx, "TRD_PLUS_DI": plus, "TRD_MINUS_DI": minus, "TRD_RSI": strength})
    return df.withColumn("COMBINED_TREND", F.when(F.col("COMBINED_TREND_SIGNAL") == "BUY", 1).when(F.col("COMBINED_TREND_SIGNAL") == "SELL", -1).otherwise(0))


def columns_of(name: str) -> tuple[str, ...]:
    return TREND if name == "TRD" else RECURSIVE[name] if name in RECURSIVE else NATIVE[name][1]


def indicators(bars: DataFrame, names: tuple[str, ...] | list[str] = DEFAULT_SET, fill: str = "null", rows: int = BLOCK_ROWS, halo: int = HALO_ROWS) -> DataFrame:
    """bars with the columns of the named indicators; any other column of bars is kept unless it has such a name.

    fill "null" leaves missing values null; "reference" puts in the last known value, else 0. The blocks are numbered,
    dealt out and checkpointed here; after that no row is exchanged, however many indicators there are.
    """
    names = list(dict.fromkeys(names))
    df = blocked(bars, rows, halo)
    summed = [n for n in names if n in SUMMED]
    recursive = [n for n in names if n in RECURSIVE] + (["ADX", "RSI"] if "TRD" in names else [])
    if summed or recursive:
        df = recursive_indicators(df, recursive, dict(SUMMED[n] for n in summed), [NATIVE[n][0]() for n in summed])
    df = apply(df, *[NATIVE[n][0]() for n in names if n in NATIVE and n not in SUMMED])
    if "TRD" in names:
        df = trend(df)
    wanted = list(dict.fromkeys(c for n in names for c in columns_of(n)))
    if fill == "reference":
        df = filled(df, wanted)
    return finished(df).select(*bars.columns, *[F.col(f"`{c}`") for c in wanted])


def with_history(bars: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Bars of the keys that have so many rows at least. A count that is combined in tasks, and a semi join."""
    enough = bars.groupBy("symbol", "interval").count().where(F.col("count") >= least)
    return bars.join(enough, ["symbol", "interval"], "left_semi")


def guarded(bars: DataFrame, names: tuple[str, ...] | list[str] = DEFAULT_SET, least: int = LEAST_ROWS) -> DataFrame:
    """indicators() of the keys that have so many rows at least; the bars of shorter keys stay, with nulls. So a series of a few derived bars has none."""
    rows = indicators(with_history(bars, least), names)
    short = bars.join(bars.groupBy("symbol", "interval").count().where(F.col("count") < least), ["symbol", "interval"], "left_semi")
    return rows.unionByName(short, allowMissingColumns=True)
