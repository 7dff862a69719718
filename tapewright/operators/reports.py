"""Reports of a key's rows: backtest, trend report and strength, spike filter, quality gate, composite analysis and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.native import ratio
from tapewright.operators.bars import tail
from tapewright.operators.blocks import blocked, finished, last, series
from tapewright.plans.dims import KEY


def _step(column: str) -> Column:
    """From a blocked row to the next one of its series."""
    return F.lead(column).over(series())


def backtest(df: DataFrame, lookback: int = 50, threshold: float = 50.0) -> DataFrame:
    """Key, total_return, win_rate, sharpe_ratio, total_signals of the trend's sides, each held for a bar; of keys with lookback + 10 rows.

    A row's return needs the row after it, so blocks overlap by one row backwards: the pair (row, next) is read off the
    later row by lag. The last row gives a signal but no return.
    """
    rows = blocked(df.select(*KEY, "ts", "close", "COMBINED_TREND"), halo=1)
    before, trend = F.lag("close").over(series()), F.lag("COMBINED_TREND").over(series())
    side = F.when(trend > threshold, 1).when(trend < -threshold, -1).otherwise(0)
    rows = rows.withColumn("_return", F.when((F.col("_rn") > lookback + 1), side * (F.col("close") - before) / before)).where(~F.col("_halo"))
    out = rows.where(F.col("_rows") >= lookback + 10).groupBy(*KEY).agg(
        F.sum("_return").alias("total"), F.avg((F.col("_return") > 0).cast("int")).alias("wins"), F.avg("_return").alias("mean"), F.stddev_pop("_return").alias("spread"), (F.max("_rows") - lookback).alias("total_signals")
    )
    sharpe = F.when(F.col("spread") > 0, F.col("mean") / F.col("spread")).otherwise(0.0)
    return out.select(*KEY, (F.col("total") * 100).alias("total_return"), (F.col("wins") * 100).alias("win_rate"), sharpe.alias("sharpe_ratio"), "total_signals")


def trend_report(df: DataFrame, rows: int = 24) -> DataFrame:
    """Key, latest score and signal, direction, mean and spread over the last 24 rows; INSUFFICIENT_DATA below that many."""
    recent = tail(df.select(*KEY, "ts", "COMBINED_TREND", "COMBINED_TREND_SIGNAL"), rows).groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.max_by("COMBINED_TREND", "ts").alias("latest_score"),
        F.max_by("COMBINED_TREND_SIGNAL", "ts").alias("latest_signal"),
        F.min_by("COMBINED_TREND", "ts").alias("first"),
        F.avg("COMBINED_TREND").alias("mean"),
        F.stddev_samp("COMBINED_TREND").alias("spread"),
    )
    enough = F.col("n") >= rows
    return recent.select(
        *KEY,
        "latest_score",
        "latest_signal",
        F.when(~enough, "INSUFFICIENT_DATA").when(F.col("latest_score") > F.col("first"), "UP").otherwise("DOWN").alias("direction"),
        F.when(enough, F.col("mean")).otherwise(F.col("latest_score").cast("double")).alias("avg_score"),
        F.when(enough, F.col("spread")).otherwise(0.0).alias("volatility"),
    )


def trend_strength(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Blocked rows with trend_strength: the mean of the last n scores, less by their spread in hundredths."""
    spread = F.stddev_pop(column).over(last(n))
    return df.withColumn("trend_strength", F.when(F.col("_rn") >= n, F.avg(column).over(last(n)) * (1 - spread / 100)).otherwise(F.lit(0.0)))


def spike_filter(df: DataFrame, column: str, threshold: float = 5.0, out: str = "filtered") -> DataFrame:
    """Blocked rows with a value that is far from the mean of the two before it drawn seven tenths of the way to that mean."""
    mean = F.avg(column).over(series().rowsBetween(-2, -1))
    far = (F.col("_rn") > 2) & (F.abs(F.col(column) - mean) > threshold)
    return df.withColumn(out, F.when(far, 0.7 * mean + 0.3 * F.col(column)).otherwise(F.col(column)))


def quality_gate(bars: DataFrame, least_volatility: float = 0.001, least_rows: int = 50, most_missing: float = 0.05) -> DataFrame:
    """Key, rows, missing (share of null closes), volatility (spread of the bars' returns) and passed."""
    rows = finished(blocked(bars, halo=1).withColumn("ret", ratio(F.col("close"), F.lag("close").over(series())) - 1))
    out = rows.groupBy(*KEY).agg(F.count("*").alias("rows"), F.avg(F.col("close").isNull().cast("int")).alias("missing"), F.stddev_samp("ret").alias("volatility"))
    passed = (F.col("rows") >= least_rows) & (F.col("missing") <= most_missing) & F.coalesce(F.col("volatility") >= least_volatility, F.lit(False))
    return out.withColumn("passed", passed)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Key, value, n, share: how often each label stands among a key's rows."""
    counts = df.groupBy(*KEY, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*KEY)))


def _changes(df: DataFrame) -> DataFrame:
    """Rows (of tpd, so few for each key) with whether the signal differs from the row before; the first one does."""
    before = F.lag("TPD_Signal").over(Window.partitionBy(*KEY).orderBy("ts"))
    return df.withColumn("_changed", F.coalesce(F.col("TPD_Signal") != before, F.lit(True)).cast("int"))


def analysis(df: DataFrame) -> DataFrame:
    """The newest composite row of each key, rounded, with the distribution of its last 10 signals and the stability of all."""
    newest = tail(df, 1).select(
        *KEY,
        F.col("TPD_Signal").alias("current_signal"),
        *[F.bround(c, 2).alias(n) for c, n in (("TPD", "tpd_score"), ("TPD_Reliability", "reliability"), ("TPD_Momentum", "momentum"), ("TPD_Strength", "signal_strength"), ("TPD_MTF_Confluence", "confluence"), ("TPD_Volatility_Factor", "volatility_factor"))],
        F.col("TPD_Trend").alias("trend"),
        F.col("TPD_Risk").alias("risk_level"),
        F.col("TPD_Divergence").alias("divergence"),
    )
    stability = _changes(df).groupBy(*KEY).agg((1 - F.sum("_changed") / F.count("*")).alias("signal_stability"))
    recent = tail(df, 10).groupBy(*KEY, "TPD_Signal").count()
    spread = recent.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("TPD_Signal", "count")))).alias("recent_signals"))
    return newest.join(stability, list(KEY)).join(spread, list(KEY))


def recommendation(analysed: DataFrame) -> DataFrame:
    """Action, position size, stop and target in percent, and the reasons."""
    signal, rel = F.col("current_signal"), F.col("reliability")
    side = F.when(signal.isin("STRONG_BUY", "BUY"), "BUY").when(signal.isin("STRONG_SELL", "SELL"), "SELL").when(signal.isin("WEAK_BUY", "WEAK_SELL"), "WAIT").otherwise("NEUTRAL")
    careful = F.when((F.col("risk_level") == "HIGH") & side.isin("BUY", "SELL"), F.concat(F.lit("CAUTIOUS_"), side)).otherwise(side)
    action = F.when(rel < 0.5, "WAIT").otherwise(careful)
    size = F.when((F.col("signal_strength") > 0.7) & (rel > 0.7), "NORMAL").when((F.col("signal_strength") > 0.5) & (rel > 0.5), "REDUCED").otherwise("MINIMAL")
    takes_side = action.endswith("BUY") | action.endswith("SELL")
    reasons = F.concat_ws(
        " | ",
        F.when(signal.isin("STRONG_BUY", "BUY"), "strong buy signal").when(signal.isin("STRONG_SELL", "SELL"), "strong sell signal").when(signal.isin("WEAK_BUY", "WEAK_SELL"), "weak signal, be careful"),
        F.when(rel > 0.7, "high reliability").when(rel > 0.5, "medium reliability").otherwise("low reliability, high risk"),
        F.when(F.abs("momentum") > 3, "strong momentum").when(F.abs("momentum") > 1, "medium momentum").otherwise("weak momentum"),
        F.when(F.col("trend") == "UPTREND", "rising trend").when(F.col("trend") == "DOWNTREND", "falling trend").otherwise("flat trend"),
        F.concat(F.lower("risk_level"), F.lit(" risk")),
        F.when(F.col("divergence") == "BEARISH_DIVERGENCE", "bearish divergence").when(F.col("divergence") == "BULLISH_DIVERGENCE", "bullish divergence"),
    )
    return analysed.select(
        *KEY,
        action.alias("action"),
        size.alias("position_size"),
        rel.alias("confidence"),
        F.when(takes_side, 2.0 * F.col("volatility_factor")).alias("stop_loss_pct"),
        F.when(takes_side, 4.0 * F.col("volatility_factor")).alias("take_profit_pct"),
        "risk_level",
        reasons.alias("rationale"),
    )


def metrics(df: DataFrame) -> DataFrame:
    """Signal changes and frequency, mean reliability and strength, and the volatility factor's statistics of each key."""
    return _changes(df).groupBy(*KEY).agg(
        F.sum("_changed").alias("total_signals"),
        F.avg("_changed").alias("signal_frequency"),
        F.bround(F.avg("TPD_Reliability"), 3).alias("avg_reliability"),
        F.bround(F.avg("TPD_Strength"), 3).alias("avg_signal_strength"),
        F.avg("TPD_Volatility_Factor").alias("volatility_mean"),
        F.stddev_samp("TPD_Volatility_Factor").alias("volatility_std"),
        F.min("TPD_Volatility_Factor").alias("volatility_min"),
        F.max("TPD_Volatility_Factor").alias("volatility_max"),
        F.count("*").alias("total_rows"),
        sum((F.sum(F.col(c).isNull().cast("int")) for c in df.columns[1:]), F.sum(F.col(df.columns[0]).isNull().cast("int"))).alias("null_values"),
    )
