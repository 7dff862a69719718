"""Indicators that need only windows: each function takes blocked bars and adds its columns, in stages that others share.

All use the window of blocks.series(), for which blocks are dealt out and sorted, so none of them costs an exchange. Missing values are null,
never NaN. The reference fill (last value, then 0) is a projection of its own: `filled`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.blocks import PARTITION, full, last, running_sum, series
from tapewright.operators.shared import held
from tapewright.plans.dims import KEY, WIDTHS, by_interval

#: Columns of an indicator, one dict after the other; each may use what the ones before made.
Stages = list[dict[str, Column]]
SR_PERIOD, SR_TOLERANCE = 14, 0.003
FIB_LEVELS = {"Fib_0": 0.0, "Fib_236": 0.236, "Fib_382": 0.382, "Fib_500": 0.5, "Fib_618": 0.618, "Fib_786": 0.786, "Fib_1000": 1.0}


def previous(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def change() -> Column:
    return F.col("close") - previous("close")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero denominator."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def apply(df: DataFrame, *many: Stages) -> DataFrame:
    """df with the columns of all stages. The k-th stages of all go together, so windows of many indicators are one operator."""
    for k in range(max(map(len, many), default=0)):
        df = df.withColumns({name: value for stages in many if k < len(stages) for name, value in stages[k].items()})
    return df


def staged(f: Callable[..., Stages]) -> Callable[..., DataFrame]:
    """The indicator as a function of a frame; `stages` gives its columns alone."""

    @wraps(f)
    def on_frame(df: DataFrame, *args, **options) -> DataFrame:
        return apply(df, f(*args, **options))

    on_frame.stages = f
    return on_frame


def _gains() -> Stages:
    return [{"_change": F.coalesce(change(), F.lit(0.0))}, {"_gain": F.greatest(F.col("_change"), F.lit(0.0)), "_loss": F.greatest(-F.col("_change"), F.lit(0.0))}]


@staged
def rsm(n: int = 14) -> Stages:
    """RSI by plain means; a mean loss of 0 counts as 1; 0 while there are too few rows."""
    gain, loss = F.avg("_gain").over(last(n)), F.avg("_loss").over(last(n))
    rs = gain / F.when(loss == 0, 1.0).otherwise(loss)
    return [*_gains(), {"RSM": F.coalesce(full(100 - 100 / (1 + rs), n), F.lit(0.0))}]


@staged
def trp(n: int = 13) -> Stages:
    up, down = F.sum("_gain").over(last(n)), F.sum("_loss").over(last(n))
    return [*_gains(), {"TRP": F.coalesce(full(ratio(100 * (up - down), up + down), n), F.lit(0.0))}]


@staged
def mfi(n: int = 14) -> Stages:
    flow = F.col("_tp") * F.col("volume")
    sides = {"_in": F.when(F.col("_tp") > F.col("_tp_before"), flow).otherwise(0.0), "_out": F.when(F.col("_tp") < F.col("_tp_before"), flow).otherwise(0.0)}
    up, down = F.sum("_in").over(last(n)), F.sum("_out").over(last(n))
    return [{"_tp": typical()}, {"_tp_before": previous("_tp")}, sides, {"MFI": full(F.when(up + down < 1, 0.0).otherwise(100 * ratio(up, up + down)), n + 1)}]


@staged
def cmf(n: int = 20) -> Stages:
    spread = F.col("high") - F.col("low")
    multiplier = F.coalesce(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread), F.lit(0.0))
    return [{"_mfv": multiplier * F.col("volume")}, {"CMF": full(ratio(F.sum("_mfv").over(last(n)), F.sum("volume").over(last(n))), n)}]


@staged
def cci(n: int = 9, name: str = "CCI") -> Stages:
    deviation = F.aggregate("_frame", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_mean"))) / n
    value = full(F.when(deviation < 1e-12, 0.0).otherwise((F.col("_ctp") - F.col("_mean")) / (0.015 * deviation)), n)
    return [{"_ctp": typical()}, {"_frame": F.collect_list("_ctp").over(last(n)), "_mean": F.avg("_ctp").over(last(n))}, {name: value}]


@staged
def williams(n: int = 14) -> Stages:
    high, low = F.max("high").over(last(n)), F.min("low").over(last(n))
    return [{"WIL": full(F.coalesce(100 * ratio(F.col("close") - high, high - low), F.lit(0.0)), n)}]


@staged
def stochastic(n: int = 14, smooth: int = 3) -> Stages:
    high, low = F.max("high").over(last(n)), F.min("low").over(last(n))
    return [{"Stoch_K": full(100 * ratio(F.col("close") - low, high - low), n)}, {"Stoch_D": full(F.avg("Stoch_K").over(last(smooth)), n + smooth - 1)}]


@staged
def net_volume(z_window: int = 100, z_least: int = 5) -> Stages:
    """Signed volume, its sum over the width's period, and that sum's z-score over the last 100 rows (0 where it doesn't spread)."""
    signed = F.when(F.col("_step") > 0, F.col("volume")).when(F.col("_step") < 0, -F.col("volume")).otherwise(0.0)
    periods = sorted({w.volume_period for w in WIDTHS.values()})
    period = F.coalesce(by_interval({k: w.volume_period for k, w in WIDTHS.items()}), F.lit(30))
    total = F.coalesce(*[F.when(period == n, F.sum("Net_Volume_Raw").over(last(n))) for n in periods])
    mean, spread = F.avg("Net_Volume").over(last(z_window)), F.stddev_samp("Net_Volume").over(last(z_window))
    z = F.when(F.col("_rn") >= z_least, F.coalesce(ratio(F.col("Net_Volume") - mean, F.when(spread > 1e-9, spread)), F.lit(0.0)))
    return [{"_step": change()}, {"Net_Volume_Raw": signed}, {"Net_Volume": total}, {"Net_Volume_Z": z}]


@staged
def cvd_steps() -> Stages:
    """CVD_Delta, whose running sum is the CVD, and its sums over windows."""
    delta = F.when(F.col("close") > F.col("open"), F.col("volume")).when(F.col("close") < F.col("open"), -F.col("volume")).otherwise(0.0)
    return [{"CVD_Delta": delta}, {"CVD_Mom": F.sum("CVD_Delta").over(last(20)), "CVD_Slope": full(F.sum("CVD_Delta").over(last(5)), 6)}]


def cvd(df: DataFrame) -> DataFrame:
    return running_sum(cvd_steps(df), {"CVD": "CVD_Delta"})


@staged
def vwap() -> Stages:
    """Volume-weighted typical price since the day began; null while the day has no volume. A day has at most 1,440 bars, fewer than the halo."""
    day = Window.partitionBy(*PARTITION, "_day").orderBy("_chunk", "_rn").rowsBetween(Window.unboundedPreceding, 0)
    return [{"_day": F.to_date("ts"), "_tpv": typical() * F.col("volume")}, {"VWAP": ratio(F.sum("_tpv").over(day), F.sum("volume").over(day))}]


@staged
def sma(*periods: int) -> Stages:
    return [{f"SMA_{n}": full(F.avg("close").over(last(n)), n) for n in periods or (20, 50, 200)}]


@staged
def bollinger(n: int = 20, width: float = 2.0) -> Stages:
    mean, spread = F.avg("close").over(last(n)), F.stddev_samp("close").over(last(n))
    return [{"BB_Upper": full(mean + width * spread, n), "BB_Middle": full(mean, n), "BB_Lower": full(mean - width * spread, n)}]


@staged
def obv_steps(tie: str = "add") -> Stages:
    """_obv_step, whose running sum is the OBV. tie "add": an unchanged close adds the volume; "zero": it adds nothing."""
    up = F.col("close") >= F.col("_close_before") if tie == "add" else F.col("close") > F.col("_close_before")
    step = F.when(F.col("_close_before").isNull() | up, F.col("volume")).when(F.col("close") < F.col("_close_before"), -F.col("volume")).otherwise(0.0)
    return [{"_close_before": previous("close")}, {"_obv_step": step}]


def obv(df: DataFrame, tie: str = "add", name: str = "OBV") -> DataFrame:
    """On-balance volume."""
    return running_sum(obv_steps(df, tie), {name: "_obv_step"})


@staged
def vortex(n: int = 14) -> Stages:
    """VI+ and VI-. The first row has no true range, so the first value stands in row n + 1."""
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_cb")), F.abs(F.col("low") - F.col("_cb")))
    moves = {"_tr": true_range, "_vp": F.abs(F.col("high") - F.col("_lb")), "_vm": F.abs(F.col("low") - F.col("_hb"))}
    total = F.sum("_tr").over(last(n))
    lines = {"VI+": full(ratio(F.sum("_vp").over(last(n)), total), n + 1), "VI-": full(ratio(F.sum("_vm").over(last(n)), total), n + 1)}
    return [{"_cb": previous("close"), "_lb": previous("low"), "_hb": previous("high")}, moves, lines]


@staged
def force() -> Stages:
    return [{"FRC": change() * F.col("volume")}]


@staged
def support_resistance(n: int = SR_PERIOD) -> Stages:
    lines = {"SR_SUPPORT": full(F.min("low").over(last(n)), n), "SR_RESISTANCE": full(F.max("high").over(last(n)), n)}
    return [lines, {"SR_SIGNAL": sr_signal(F.col("close"), F.col("SR_SUPPORT"), F.col("SR_RESISTANCE"))}]


def sr_signal(close: Column, support: Column, resistance: Column, tolerance: float = SR_TOLERANCE) -> Column:
    usable = F.coalesce(close.isNotNull() & (resistance - support > 0), F.lit(False))
    nearer_above = (resistance - close) < (close - support)
    return (
        F.when(~usable, "neutral")
        .when(close >= resistance * (1 - tolerance), "resistance")
        .when(close <= support * (1 + tolerance), "support")
        .otherwise(F.when(nearer_above, "near_resistance").otherwise("near_support"))
    )


@staged
def fibonacci(n: int = 100) -> Stages:
    """Retracement levels between the highest high and the lowest low of the last n rows; null where they are equal."""
    spread = F.nullif(F.col("Fib_High") - F.col("Fib_Low"), F.lit(0.0))
    levels = {name: F.round(F.col("Fib_High") - spread * part, 8) for name, part in FIB_LEVELS.items()}
    return [{"Fib_High": F.max("high").over(last(n)), "Fib_Low": F.min("low").over(last(n))}, levels]


def fib_nearest(price: Column) -> Column:
    """struct(distance, place, name, level) of the level that is nearest to a price; of equal distances the first."""
    levels = [F.struct(F.abs(F.col(n) - price).alias("distance"), F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(n).alias("level")) for i, n in enumerate(FIB_LEVELS)]
    return F.when(F.col("Fib_0").isNotNull(), F.array_min(F.array(*levels)))


def fib_around(price: Column) -> Column:
    """struct(nearest, support, resistance): the level nearest to a price, and the next ones below and above that level, each struct(level, name); null where there is none."""
    levels = F.array(*[F.struct(F.col(n).alias("level"), F.lit(n).alias("name")) for n in FIB_LEVELS])
    near = fib_nearest(price)
    at = F.struct(near["level"].alias("level"), near["name"].alias("name"))
    below = F.array_max(F.filter(levels, lambda x: x["level"] < near["level"]))
    above = F.array_min(F.filter(levels, lambda x: x["level"] > near["level"]))
    return F.when(near.isNotNull(), F.struct(at.alias("nearest"), below.alias("support"), above.alias("resistance")))


#: The indicators, and what each of them adds. CVD and OBV need a running sum besides (indicators.SUMMED).
NATIVE: dict[str, tuple[Callable[[], Stages], tuple[str, ...]]] = {
    "RSM": (rsm.stages, ("RSM",)),
    "TRP": (trp.stages, ("TRP",)),
    "MFI": (mfi.stages, ("MFI",)),
    "CMF": (cmf.stages, ("CMF",)),
    "CCI": (cci.stages, ("CCI",)),
    "WIL": (williams.stages, ("WIL",)),
    "STOCH": (stochastic.stages, ("Stoch_K", "Stoch_D")),
    "VOL": (net_volume.stages, ("Net_Volume_Raw", "Net_Volume", "Net_Volume_Z")),
    "CVD": (cvd_steps.stages, ("CVD_Delta", "CVD", "CVD_Mom", "CVD_Slope")),
    "VWAP": (vwap.stages, ("VWAP",)),
    "SMA_20": (lambda: sma.stages(20), ("SMA_20",)),
    "SMA_50": (lambda: sma.stages(50), ("SMA_50",)),
    "SMA_200": (lambda: sma.stages(200), ("SMA_200",)),
    "BOL": (bollinger.stages, ("BB_Upper", "BB_Middle", "BB_Lower")),
    "OBV": (obv_steps.stages, ("OBV",)),
    "VRT": (vortex.stages, ("VI+", "VI-")),
    "FRC": (force.stages, ("FRC",)),
    "SR": (support_resistance.stages, ("SR_SUPPORT", "SR_RESISTANCE", "SR_SIGNAL")),
    "Fibonacci": (fibonacci.stages, (*FIB_LEVELS, "Fib_High", "Fib_Low")),
}


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blocked rows with the last known value in place of a null, however far back in the series it stands, then 0 for numbers."""
    df = held(df)  # once for the blocks' ends, once for the rows
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(df.dtypes)
    own = {c: F.col(f"`{c}`") for c in columns}
    ends = df.where(~F.col("_halo")).groupBy(*PARTITION).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("_rn"))).alias(f"_e{i}") for i, v in enumerate(own.values())])
    carry = held(ends.select(*PARTITION, *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(own))]))
    known = {c: F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_c{i}")) for i, (c, v) in enumerate(own.items())}
    return df.join(carry, list(PARTITION)).withColumns({c: v if kinds[c] == "string" else F.coalesce(v, F.lit(0).cast(kinds[c])) for c, v in known.items()})
