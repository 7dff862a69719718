"""Raw messages as text files in folders by symbol and interval, read in whole or as a stream; a second source where the first has nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.plans.dims import KEY

RAW = "value string, symbol string, interval string"


def write_messages(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows of (value, symbol, interval), a message a line."""
    raw.select("value", *KEY).write.mode(mode).partitionBy(*KEY).text(path)


def read_messages(spark: SparkSession, path: str, symbols: list[str] | None = None, intervals: list[str] | None = None, stream: bool = False) -> DataFrame:
    """value, symbol, interval of the files under a path. Wanted symbols and intervals prune folders; a stream remembers the files that it has read."""
    rows = (spark.readStream if stream else spark.read).schema(RAW).text(path)
    for name, wanted in zip(KEY, (symbols, intervals), strict=True):
        if wanted is not None:
            rows = rows.where(F.col(name).isin(*wanted))
    return rows


def first_source(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary, and of secondary the rows of the pairs of symbol and interval that primary has no row of, with the name of the source."""
    missing = secondary.join(primary.select(*KEY).distinct(), list(KEY), "left_anti")
    return primary.withColumn("source", F.lit("primary")).unionByName(missing.withColumn("source", F.lit("secondary")))
