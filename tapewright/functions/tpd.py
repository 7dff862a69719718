"""The composite oscillator TPD and its derived columns, over the last rows of each key (as many as its width's window).

The rows of a key are bounded by that window (at most 300), so every window below is small however long the history is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.native import cci, mfi, ratio, williams
from tapewright.functions.recursive import recursive_indicators
from tapewright.operators.blocks import blocked, finished, last, series
from tapewright.plans.dims import KEY, WIDTHS, by_interval

LEAST_ROWS, MOST_NULLS = 50, 0.1
# Shares of the five oscillators.
SHARES = {"rsi": 0.25, "mfi": 0.25, "smi": 0.25, "cci": 0.15, "wil": 0.10}
STRONG_LEVEL, LEVEL = 45.0, 15.0
OUTPUTS = ("TPD", "TPD_Reliability", "TPD_Momentum", "TPD_Volatility_Factor", "TPD_Raw_Signal", "TPD_Divergence", "TPD_Signal", "TPD_Trend", "TPD_Risk", "TPD_MTF_Confluence", "TPD_Strength")
BUYS = ("STRONG_BUY", "BUY", "WEAK_BUY", "MOMENTUM_REVERSAL_BUY")
SELLS = ("STRONG_SELL", "SELL", "WEAK_SELL", "MOMENTUM_REVERSAL_SELL")


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def roll(column: str, n: int, agg=F.avg) -> Column:
    """An aggregate of the last n rows; null unless all of them are known."""
    return F.when(F.count(column).over(last(n)) == n, agg(column).over(last(n)))


def either(value: Column, default: float) -> Column:
    return F.coalesce(value, F.lit(default))


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def window_rows(bars: DataFrame) -> DataFrame:
    """The last rows of each key that has LEAST_ROWS of them, with at most MOST_NULLS of their values missing."""
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts")))
    size = F.coalesce(by_interval({k: w.window for k, w in WIDTHS.items()}), F.lit(200))
    most = max(w.window for w in WIDTHS.values())
    rows = bars.withColumn("_new", newest).where(F.col("_new") <= most).where(F.col("_new") <= size).drop("_new")
    nulls = reduce(lambda a, b: a + b, [F.avg(F.col(c).isNull().cast("int")) for c in ("open", "high", "low", "close", "volume")]) / 5
    good = rows.groupBy(*KEY).agg(F.count("*").alias("n"), nulls.alias("nulls")).where((F.col("n") >= LEAST_ROWS) & (F.col("nulls") <= MOST_NULLS))
    return rows.join(good.select(*KEY), list(KEY), "left_semi")


def volatility(df: DataFrame) -> DataFrame:
    """_std, _var, _parkinson, _garman and _factor, how volatile a row is against the last 50."""
    df = df.withColumns({"_ret": ratio(F.col("close"), F.lag("close").over(series())) - 1, "_hl2": F.ln(F.col("high") / F.col("low")) ** 2, "_co2": F.ln(F.col("close") / F.col("open")) ** 2})
    df = df.withColumn("_gk", 0.5 * F.col("_hl2") - (2 * F.ln(F.lit(2.0)) - 1) * F.col("_co2"))
    year = F.sqrt(F.lit(252.0))
    root = lambda c: F.when(c >= 0, F.sqrt(c))
    df = df.withColumns({"_std": roll("_ret", 20, F.stddev_samp), "_var": roll("_ret", 20, F.var_samp), "_parkinson": root(roll("_hl2", 20)) * year, "_garman": root(roll("_gk", 20)) * year})
    part = lambda c: either(ratio(F.col(c), roll(c, 50)), 1.0)
    return df.withColumn("_factor", 0.4 * part("_std") + 0.3 * part("_parkinson") + 0.3 * part("_garman"))


def oscillators(df: DataFrame) -> DataFrame:
    df = williams(cci(mfi(df), 14, "_cci"))
    middle = F.col("close") - (F.max("high").over(last(14)) + F.min("low").over(last(14))) / 2
    spread = F.max("high").over(last(14)) - F.min("low").over(last(14))
    full = F.col("_rn") >= 14
    # a range of zero counts as missing, and a missing oscillator as 0
    df = df.withColumns({"_mid": F.when(full, middle), "_spread": F.nullif(F.when(full, spread), F.lit(0.0))})
    df = df.withColumn("_smi", either(ratio(100 * roll("_mid", 3), roll("_spread", 3) / 2), 0.0))
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({new: F.last(old, ignorenulls=True).over(upto) for new, old in {"_f_rsi": "RSI", "_f_mfi": "MFI", "_f_smi": "_smi", "_f_cci": "_cci", "_f_wil": "WIL", "_f_adx": "ADX"}.items()})
    z = ratio(F.col("_f_cci") - roll("_f_cci", 100), roll("_f_cci", 100, F.stddev_samp))
    return df.withColumns(
        {
            "_n_rsi": (F.col("_f_rsi") - 50) * 2,
            "_n_mfi": (F.col("_f_mfi") - 50) * 2,
            "_n_smi": clip(F.col("_f_smi"), -100, 100),
            "_n_cci": either(clip(z * 20, -100, 100), 0.0),
            "_n_wil": F.col("_f_wil") * 2 + 100,
            "_adx": clip(F.col("_f_adx") / 50, 0, 1),
        }
    )


def score(df: DataFrame) -> DataFrame:
    """TPD: the oscillators' weighted mean, with weights that shift in volatile and busy rows."""
    whole = Window.partitionBy(*KEY)
    df = df.withColumns({"_q70": F.percentile("_factor", 0.7).over(whole), "_busy": ratio(F.col("volume"), roll("volume", 20))})
    wild, busy = known(F.col("_factor") > F.col("_q70")), known(F.col("_busy") > 1.5)
    more = {"rsi": ((wild, 1.2), (busy, 1.1)), "cci": ((wild, 1.3),), "smi": ((wild, 1.1),), "mfi": ((busy, 1.15),)}
    df = df.withColumns({f"_w_{k}": reduce(lambda w, m: w * F.when(m[0], m[1]).otherwise(1.0), more.get(k, ()), F.lit(v)) for k, v in SHARES.items()})
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    mean = add([F.col(f"_n_{k}") * F.col(f"_w_{k}") for k in SHARES]) / add([F.col(f"_w_{k}") for k in SHARES])
    return df.withColumn("TPD", either(mean * (0.5 + 0.5 * F.col("_adx")) * (1 + 0.3 * (F.col("_factor") - 1)), 0.0))


def reliability() -> Column:
    sign = lambda c, at: F.when(known(F.col(c) > at), 1).otherwise(-1)
    agree = F.abs(sign("_f_rsi", 50) + sign("_f_mfi", 50) + sign("_f_smi", 0) + sign("_f_cci", 0) + sign("_f_wil", -50)) / 5
    by_trend = F.when(F.col("_f_adx") > 25, 1.0).when(F.col("_f_adx") > 15, 0.8).otherwise(0.6)
    by_volume = F.when(known(F.col("_busy") > 0.8), 1.0).otherwise(0.7)
    calm = F.when(F.col("_factor") > 1.2, 0.7).when(F.col("_factor") > 0.8, 0.9).otherwise(1.0)
    return 0.3 * by_trend + 0.3 * by_volume + 0.2 * calm + 0.2 * agree


def raw_signal() -> Column:
    """The first that holds, strongest first."""
    tpd, m, b, sb = F.col("TPD"), F.col("TPD_Momentum"), F.col("_level"), F.col("_strong")
    hi = F.col("TPD_Reliability") > 0.5
    med = (F.col("TPD_Reliability") > 0.3) & ~hi
    rising, falling = known(tpd > F.col("_tpd_before")), known(tpd < F.col("_tpd_before"))
    return (
        F.when((tpd < -sb) & hi & (m < -2), "STRONG_SELL")
        .when((tpd > sb) & hi & (m > 2), "STRONG_BUY")
        .when((tpd < -b) & (tpd >= -sb) & hi & (m < 1), "SELL")
        .when((tpd > b) & (tpd <= sb) & hi & (m > -1), "BUY")
        .when((tpd < -b) & med & (m < 2), "WEAK_SELL")
        .when((tpd > b) & med & (m > -2), "WEAK_BUY")
        .when((tpd > 0) & (m < -3) & hi & falling, "MOMENTUM_REVERSAL_SELL")
        .when((tpd < 0) & (m > 3) & hi & rising, "MOMENTUM_REVERSAL_BUY")
        .otherwise("NEUTRAL")
    )


def signals(df: DataFrame) -> DataFrame:
    moved = lambda n: F.col("TPD") - F.lag("TPD", n).over(series())
    df = df.withColumns({"TPD_Reliability": reliability(), "TPD_Momentum": either(0.5 * moved(3) + 0.3 * moved(5) + 0.2 * moved(10), 0.0), "TPD_Volatility_Factor": F.col("_factor"), "_tpd_before": F.lag("TPD").over(series())})
    stretch = clip(1 + 0.5 * (F.col("_factor") - 1), 0.5, 1.5)
    df = df.withColumns({"_level": LEVEL * stretch, "_strong": STRONG_LEVEL * stretch}).withColumn("TPD_Raw_Signal", raw_signal())
    slope = lambda c, n: F.when(F.count(c).over(last(n)) == n, F.regr_slope(F.col(c), F.col("_rn").cast("double")).over(last(n)))
    return df.withColumns({"_slope_close": slope("close", 10), "_slope_tpd": slope("TPD", 10), "_slope3": slope("TPD", 3)})


def divergence() -> Column:
    price, own = F.col("_slope_close"), F.col("_slope_tpd")
    return (
        F.when(known((price > 0.001) & (own < -0.001)), "BEARISH_DIVERGENCE")
        .when(known((price < -0.001) & (own > 0.001)), "BULLISH_DIVERGENCE")
        .when(known(F.abs(price - own) > 0.002), "WEAK_DIVERGENCE")
        .otherwise("NO_DIVERGENCE")
    )


def confirmed(p: int) -> Column:
    """The signal after its checks over the last p + 1 rows; a strong or plain side that fails becomes weak."""
    frame = last(p + 1)
    any_of = lambda names: F.max(F.col("TPD_Raw_Signal").isin(*names).cast("int")).over(frame) == 1
    mean = F.avg("TPD_Momentum").over(frame)
    step = F.col("TPD_Momentum") - F.lag("TPD_Momentum", p).over(series())
    raw, other = F.col("TPD_Raw_Signal"), F.col("TPD_Divergence")
    buy_ok = ~any_of(SELLS) & known((mean > -2) & (step > -1)) & (other != "BEARISH_DIVERGENCE")
    sell_ok = ~any_of(BUYS) & known((mean < 2) & (step < 1)) & (other != "BULLISH_DIVERGENCE")
    weak = other == "WEAK_DIVERGENCE"
    return (
        F.when(raw.isin("BUY", "STRONG_BUY") & (~buy_ok | (weak & (raw == "STRONG_BUY"))), "WEAK_BUY")
        .when(raw.isin("SELL", "STRONG_SELL") & (~sell_ok | (weak & (raw == "STRONG_SELL"))), "WEAK_SELL")
        .otherwise(raw)
    )


def risk() -> Column:
    by_volume = either(clip(1 - F.col("_busy"), 0, 1), 0.5)
    total = 0.4 * clip((F.col("_factor") - 1) * 2, 0, 1) + 0.3 * by_volume + 0.3 * clip(F.abs("TPD_Momentum") / 10, 0, 1)
    return F.when(total > 0.7, "HIGH").when(total < 0.3, "LOW").otherwise("MEDIUM")


def weighted(bars: DataFrame) -> DataFrame:
    """The blocked last rows of each key with TPD and the oscillators' weights in it (_w_ and the name)."""
    return score(oscillators(volatility(recursive_indicators(blocked(window_rows(bars)), ("RSI", "ADX")))))


def tpd(bars: DataFrame) -> DataFrame:
    """The last rows of each key with OUTPUTS and the parts that they are made of; keys with too few rows give none."""
    df = signals(weighted(bars))
    df = df.withColumn("TPD_Divergence", divergence())
    df = df.withColumn("TPD_Signal", F.when(F.col("interval").isin("1m", "3m", "5m"), confirmed(3)).otherwise(confirmed(2)))
    df = df.withColumns({"_s5": roll("TPD", 5), "_s10": roll("TPD", 10), "_s20": roll("TPD", 20)})
    above = lambda c: known(F.col(c) > 0)
    same = lambda a, b: (above(a) == above(b)).cast("double")
    confluence = 0.4 * same("_s5", "_s10") + 0.4 * same("_s10", "_s20") + 0.2 * clip(F.abs(F.col("_s5") - F.col("_s20")) / 50, 0, 1)
    strength = F.abs("TPD") / 100 * F.col("TPD_Reliability") * clip(either(ratio(F.lit(1.0), F.col("_factor")), 1.0), 0.5, 1.2) * (1 + 0.3 * clip(F.abs("TPD_Momentum") / 5, 0, 1))
    df = df.withColumns(
        {
            "TPD_Trend": F.when(known(F.col("_slope3") > 0.5), "UPTREND").when(known(F.col("_slope3") < -0.5), "DOWNTREND").otherwise("SIDEWAYS"),
            "TPD_Risk": risk(),
            "TPD_MTF_Confluence": confluence,
            "TPD_Strength": clip(strength, 0, 1),
        }
    )
    return finished(df.withColumns({"tpd_std": F.col("_std"), "tpd_parkinson": F.col("_parkinson"), "tpd_garman_klass": F.col("_garman")})).select(*bars.columns, *OUTPUTS, "tpd_std", "tpd_parkinson", "tpd_garman_klass")
