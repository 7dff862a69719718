"""Joins and set operations that the engine's jobs share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.plans.dims import interval_table


def active(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is known."""
    return rows.join(known, key, "left_semi")


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't known; a null key never is."""
    return rows.join(known, key, "left_anti")


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """UNION, INTERSECT or EXCEPT of distinct rows."""
    return {"UNION": lambda: left.union(right).distinct(), "INTERSECT": lambda: left.intersect(right), "EXCEPT": lambda: left.subtract(right)}[kind]()


def pairs(symbols: DataFrame, intervals: list[str]) -> DataFrame:
    """Each symbol with each of a fixed list of intervals: an explode of a literal, no join."""
    return symbols.select("symbol", F.explode(F.array(*[F.lit(i) for i in intervals])).alias("interval"))


def with_parameters(rows: DataFrame) -> DataFrame:
    """rows with the parameters of their interval. The table has thirteen rows, so it is broadcast; unknown widths have none."""
    return rows.join(F.broadcast(interval_table(rows.sparkSession)), "interval", "left")


def with_source(rows: DataFrame, sources: DataFrame, default: str = "binance") -> DataFrame:
    return rows.join(sources.select("symbol", F.col("source").alias("_source")), "symbol", "left").withColumn("source", F.coalesce("_source", F.lit(default))).drop("_source")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, other: str, tolerance: int) -> DataFrame:
    """left rows with the nearest right place within the tolerance, of two the earlier; left rows without one are left out.

    A range join as an equi-join: places are put into cells as wide as the tolerance, and a left row looks into its own
    cell and the two beside it. So a hot `by` is spread over its cells.
    """
    width = max(1, tolerance)
    cells = left.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(at) / width) + d)))
    joined = cells.join(right.withColumn("_cell", F.floor(F.col(other) / width)), [by, "_cell"])
    distance = F.abs(F.col(at) - F.col(other))
    return joined.where(distance <= tolerance).groupBy(by, at).agg(F.min_by(other, F.struct(distance, F.col(other))).alias(other))
