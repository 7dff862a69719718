"""Ticks (symbol, ts, id, price, size) from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(events: DataFrame) -> DataFrame:
    """An event is a tick: its type the symbol, its value the price, `k` of its JSON properties the size. Prices that aren't above 0 are left out."""
    size = F.get_json_object("props", "$.k").cast("double")
    return events.where(F.col("value") > 0).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), F.coalesce(size, F.lit(0.0)).alias("size"))


def order_ticks(orders: DataFrame) -> DataFrame:
    """An order is a tick of its priority, at its total price, of size 1."""
    return orders.where(F.col("o_totalprice") > 0).select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"))
