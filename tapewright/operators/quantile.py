"""Exact quantiles of long series, without sorting a key in one task.

The value at a rank is found by counting: each pass counts a key's values in CELLS equal ranges between the bounds so
far, in tasks first, and goes on in the range that holds the rank. When that range holds few rows, or only one value,
its rows alone are put in order. Every pass is one aggregate over the rows; a key never has more than CELLS counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.shared import held

CELLS, FEW_ROWS = 1024, 10_000
#: Keys whose bounds are broadcast, at most; with more, bounds are joined by key.
BROADCAST_KEYS = 200_000


def exact_quantile(rows: DataFrame, key: str, value: str, q: float, few: int = FEW_ROWS, cells: int = CELLS) -> DataFrame:
    """key, n, quantile: of each key's known values the quantile q (0 to 1), between two values by linear interpolation.

    Null and NaN values don't count; a key without others has no row, nor has an empty table. A null key is a key.
    """
    own = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = own.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.lit(float(q)) * (F.col("n") - 1)
    ranks = sizes.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    # rank counts from the first row of the range: `inside` rows between low and high
    bounds = held(ranks.select("k", "n", "low", "high", "rank", F.col("rank").alias("r"), F.col("n").alias("inside")))
    hint = F.broadcast if bounds.count() <= BROADCAST_KEYS else (lambda df: df)

    def within(open_bounds: DataFrame) -> DataFrame:
        b = open_bounds.withColumnRenamed("k", "bk")
        return own.join(hint(b), F.col("k").eqNullSafe(F.col("bk")) & F.col("v").between(F.col("low"), F.col("high"))).drop("bk")

    wide = (F.col("inside") > few) & (F.col("low") < F.col("high"))
    while bounds.where(wide).limit(1).count():
        cell = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells), F.lit(cells - 1))
        counts = within(bounds.where(wide)).groupBy("k", "n", "rank", "r", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("k", "rank").orderBy("cell"))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r")))
        closer = found.select("k", "n", F.col("lo").alias("low"), F.col("hi").alias("high"), "rank", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), F.col("c").alias("inside"))
        bounds = held(bounds.where(~wide).unionByName(closer))
    one = bounds.where("low = high").select("k", "n", "rank", F.col("low").alias("v"))
    place = F.row_number().over(Window.partitionBy("k", "rank").orderBy("v")) - 1
    some = within(bounds.where("low < high")).withColumn("place", place).where("place = r").select("k", "n", "rank", "v")
    both = one.unionByName(some).groupBy("k", "n").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    part = at - F.floor(at)
    return both.select(F.col("k").alias(key), "n", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("quantile"))
