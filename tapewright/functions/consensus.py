"""Weighted-vote consensus of a row's indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.plans.dims import VOTELESS, WEIGHTS

STRONG, PLAIN = 0.35, 0.15
NEAR = 0.001


def _sides(up: Column, down: Column) -> Column:
    """1, -1 or 0; a null condition is none."""
    return F.when(F.coalesce(up, F.lit(False)), 1.0).when(F.coalesce(down, F.lit(False)), -1.0).otherwise(0.0)


def _between(name: str, low: float, high: float, default: float) -> Column:
    value = F.coalesce(F.col(f"`{name}`"), F.lit(default))
    return _sides(value > high, value < low)


def _against(name: str) -> Column:
    line = F.col(f"`{name}`")
    return _sides(F.col("close") > line * (1 + NEAR), F.col("close") < line * (1 - NEAR))


def _graded(by: Column, full: float, half: float) -> Column:
    return F.when(by >= full, 1.0).when(by <= -full, -1.0).when(by >= half, 0.5).when(by <= -half, -0.5).otherwise(0.0)


def vote(name: str) -> Column:
    """An indicator's vote, -1 to 1. Missing values vote as the neutral default; unknown names vote 0."""
    if name in ("RSI", "MFI", "RSM"):
        return _between(name, 45, 55, 50)
    # Lower and upper limit, default.
    limits = {"SMI": (-20, 20, 0), "WIL": (-80, -30, -50), "CCI": (-100, 100, 0), "CMF": (-0.05, 0.05, 0), "ADO": (0, 0, 0), "TRP": (0, 0, 0), "FRC": (0, 0, 0)}
    if name in limits:
        return _between(name, *limits[name])
    if name == "CVD":
        momentum, slope = F.col("CVD_Mom"), F.col("CVD_Slope")
        side = _sides(momentum > 0, momentum < 0)
        agree = F.coalesce(slope.isNull() | (F.signum(momentum) == F.signum(slope)), F.lit(False))
        return F.when(agree, side).otherwise(side / 2)
    if name == "VOL":
        z = F.col("Net_Volume_Z")
        return F.when(z.isNotNull(), _graded(z, 2.0, 0.5)).otherwise(_between("Net_Volume", 0, 0, 0))
    if name in ("VWAP", "SMA_20", "SMA_50", "SMA_200"):
        return _against(name)
    if name == "TRD":
        return _sides(F.col("COMBINED_TREND_SIGNAL") == "BUY", F.col("COMBINED_TREND_SIGNAL") == "SELL")
    if name == "ADX":
        strong = F.col("ADX") >= 25
        return _sides(strong & (F.col("`+DI`") > F.col("`-DI`")), strong & (F.col("`-DI`") > F.col("`+DI`")))
    if name == "MCD":
        return _between("MCD_Hist", 0, 0, 0)
    if name == "EMA":
        return _between("EMA_Signal", -0.1, 0.1, 0)
    if name == "BOL":
        return _sides(F.col("close") > F.col("BB_Middle"), F.col("close") < F.col("BB_Middle"))
    if name == "VRT":
        up, down = F.coalesce(F.col("`VI+`"), F.lit(1.0)), F.coalesce(F.col("`VI-`"), F.lit(1.0))
        return _sides(up > down * 1.05, down > up * 1.05)
    return F.lit(0.0)


def weight(name: str) -> Column:
    """An indicator's weight; that of the trend counts half as much again when the trend is strong and takes a side."""
    base = F.lit(WEIGHTS.get(name, 1.0))
    if name == "TRD":
        takes_side = F.coalesce((F.col("TRD_ADX") >= 40) & F.col("COMBINED_TREND_SIGNAL").isin("BUY", "SELL"), F.lit(False))
        return F.when(takes_side, base * 1.5).otherwise(base)
    return base


def votes(name: str) -> bool:
    return name not in VOTELESS and not name.startswith("TPD")


def consensus(df: DataFrame, indicators: tuple[str, ...] | list[str], prefix: str = "kns") -> DataFrame:
    """df with the consensus of the indicators: signal, score, strength, and how many vote for, against and neither way.

    Without an indicator that votes the signal is NO_DATA and the score 0.
    """
    voting = [n for n in dict.fromkeys(indicators) if votes(n)]
    if not voting:
        values = {"signal": F.lit("NO_DATA"), "score": F.lit(0.0), "strength": F.lit(0), "buy": F.lit(0), "sell": F.lit(0), "neutral": F.lit(0)}
        return df.withColumns({f"{prefix}_{k}": v for k, v in values.items()})
    df = df.withColumns({f"_v{i}": vote(n) for i, n in enumerate(voting)})
    cast = [F.col(f"_v{i}") for i in range(len(voting))]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    score = add([v * weight(n) for v, n in zip(cast, voting, strict=True)]) / add([weight(n) for n in voting])
    df = df.withColumn("_score", score)
    s = F.col("_score")
    signal = F.when(s >= STRONG, "STRONG_BUY").when(s >= PLAIN, "BUY").when(s <= -STRONG, "STRONG_SELL").when(s <= -PLAIN, "SELL").otherwise("NEUTRAL")
    count = lambda test: add([test(v).cast("int") for v in cast])
    values = {
        "signal": signal,
        "score": F.bround(s, 3),
        "strength": F.floor(F.abs(s) * 100).cast("int"),
        "buy": count(lambda v: v > 0),
        "sell": count(lambda v: v < 0),
        "neutral": count(lambda v: v == 0),
    }
    return df.withColumns({f"{prefix}_{k}": v for k, v in values.items()}).drop("_score", *[f"_v{i}" for i in range(len(voting))])
