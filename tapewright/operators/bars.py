"""Bars: ticks to OHLCV by time bucket, wider bars from narrower ones, merges of newer rows into older ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.plans.dims import DERIVED, KEY, WIDTHS

PRICES = ("open", "high", "low", "close")


def bucket(ts: Column, seconds: int) -> Column:
    """The start of the epoch-aligned bucket with ts, as a TIMESTAMP_NTZ or TIMESTAMP like ts."""
    return F.window(ts, f"{seconds} seconds")["start"]


def resample(ticks: DataFrame, interval: str, anchor: str = "epoch") -> DataFrame:
    """Bars of one width from ticks (symbol, ts, id, price, size). Ties in ts are put in order by id; empty buckets give no bar.

    anchor "first_day" counts buckets of whole days from the first day of each symbol instead of from 1970.
    """
    order = F.struct("ts", "id")
    aggs = (
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    keyed, start = _bucketed(ticks, interval, anchor)
    return _bars(keyed.groupBy("symbol", start.alias("bucket")).agg(*aggs), interval)


def derive(bars: DataFrame, interval: str, source: str | None = None, anchor: str = "epoch") -> DataFrame:
    """Wider bars from bars of the source width (by default the one that DERIVED names). Bars without an open or close are left out."""
    source = source or DERIVED[interval][0]
    own = bars.where(F.col("interval") == source).dropna(subset=["open", "close"])
    aggs = (F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    keyed, start = _bucketed(own, interval, anchor)
    return _bars(keyed.groupBy("symbol", start.alias("bucket")).agg(*aggs), interval)


def _bucketed(rows: DataFrame, interval: str, anchor: str) -> tuple[DataFrame, Column]:
    seconds = WIDTHS[interval].seconds
    if anchor == "epoch":
        return rows, bucket(F.col("ts"), seconds)
    if seconds % 86400:
        raise ValueError("only buckets of whole days can begin at the first day")
    first = rows.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("first_day"))
    days = F.floor(F.datediff(F.to_date("ts"), "first_day") / (seconds // 86400)) * (seconds // 86400)
    return rows.join(first, "symbol"), F.date_add(F.col("first_day"), days.cast("int")).cast(rows.schema["ts"].dataType)


def _bars(grouped: DataFrame, interval: str) -> DataFrame:
    return grouped.select("symbol", F.lit(interval).alias("interval"), F.col("bucket").alias("ts"), *PRICES, "volume")


def keep_last(rows: DataFrame, order: str, by: tuple[str, ...] = (*KEY, "ts")) -> DataFrame:
    """One row for each key: that with the greatest order. A grouped maximum, so a hot key is combined in tasks first."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*by, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def merge_poll(base: DataFrame, new: DataFrame) -> DataFrame:
    """base with the rows of new in it: rows of the same bar take each value of new that isn't null, other rows are added. Duplicates must be gone (keep_last)."""
    names = [c for c in base.columns if c not in (*KEY, "ts")]
    newer = new.select(*KEY, "ts", *[F.col(c).alias(f"_{c}") for c in names])
    return base.join(newer, [*KEY, "ts"], "full_outer").select(*KEY, "ts", *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def all_bars(*frames: DataFrame) -> DataFrame:
    """UNION ALL of bars of several widths or sources."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tail(rows: DataFrame, n: int, by: tuple[str, ...] = KEY, order: str = "ts") -> DataFrame:
    """The last n rows of each key. For one row, a grouped maximum; for more, of each key only the n greatest orders are kept from each task on."""
    if n == 1:
        return keep_last(rows, order, by)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
