"""The snapshot store: Parquet by interval, with a table of what is stored, a guard against shrinking, and freshness.

Each write is a generation of its own under data/; meta/ says which generation a key's rows are read from. So a failed
write leaves the old rows in place, and no file is rewritten for the sake of another key. Compaction puts all current rows
into one generation, sorted by key; vacuum takes away generations that no key is read from any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.bars import keep_last
from tapewright.plans.dims import BAR, KEY, SNAPSHOT_TTL_S

LEAST_ROWS, LEAST_SHARE = 5, 0.5
META = "symbol string, interval string, generation string, rows long, status string, updated_at timestamp, logged_at timestamp"
BAR_NAMES = {"symbol", "interval", "ts", "open", "high", "low", "close", "volume"}


def allowed(new_rows: Column, old_rows: Column) -> Column:
    """Whether so many rows may take the place of so many: at least LEAST_ROWS, and no less than half of what is there."""
    return (new_rows >= LEAST_ROWS) & ~F.coalesce((old_rows > 0) & (new_rows < LEAST_SHARE * old_rows), F.lit(False))


def guard(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """key, n, stored_rows, write: for each key of rows whether the guard lets it be written. stored: key and rows."""
    n = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    joined = n.join(stored.select(*KEY, F.col("rows").alias("stored_rows")), list(KEY), "left")
    indicator = F.lit(bool(set(rows.columns) - BAR_NAMES))
    return joined.withColumn("write", indicator & allowed(F.col("n"), F.col("stored_rows")))


class SnapshotStore:
    """Rows with indicators by key under one path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(META).parquet(f"{self.path}/meta")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], META)

    def meta(self) -> DataFrame:
        """The newest entry of each key; deleted keys have none."""
        order = F.struct(F.coalesce("logged_at", "updated_at"), "updated_at")
        return keep_last(self._log().withColumn("_order", order), "_order", KEY).where(F.col("status") == "completed").drop("_order")

    def write(self, rows: DataFrame) -> DataFrame:
        """Stores the keys that the guard lets through and returns the guard's table. Codec: LZ4."""
        generation = uuid.uuid4().hex
        judged = guard(rows, self.meta())
        good = judged.where("write")
        out = rows.join(good.select(*KEY), list(KEY), "left_semi")
        # one file for each interval and hash of the symbol, however many keys there are
        out.repartition("interval", F.col("symbol")).write.option("compression", "lz4_raw").partitionBy("interval").parquet(f"{self.path}/data/generation={generation}")
        entry = good.select(*KEY, F.lit(generation).alias("generation"), F.col("n").alias("rows"), F.lit("completed").alias("status"), F.current_timestamp().alias("updated_at"), F.current_timestamp().alias("logged_at"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/meta")
        return judged

    def read(self, symbols: list[str] | None = None, intervals: list[str] | None = None) -> DataFrame:
        """The rows of the stored keys; interval and generation prune folders."""
        known = self.meta()
        if symbols is not None:
            known = known.where(F.col("symbol").isin(*symbols))
        if intervals is not None:
            known = known.where(F.col("interval").isin(*intervals))
        # only generations that some key is read from, so old ones neither cost a listing nor bring their columns
        used = [r.generation for r in known.select("generation").distinct().collect()]
        if not used:
            return self.spark.createDataFrame([], BAR)
        data = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/generation={g}" for g in used])
        return data.join(known.select(*KEY, "generation"), [*KEY, "generation"], "left_semi").drop("generation")

    def last_rows(self) -> DataFrame:
        """key, row: the newest row of each key as JSON, nulls left out."""
        rows = self.read()
        rest = [F.col(f"`{c}`") for c in rows.columns if c not in KEY]
        return rows.groupBy(*KEY).agg(F.to_json(F.max_by(F.struct(*rest), "ts")).alias("row"))

    def fresh(self, max_age_s: int = 300) -> DataFrame:
        """meta with age_s and fresh."""
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("updated_at")
        return self.meta().withColumn("age_s", age).withColumn("fresh", F.col("age_s") <= max_age_s)

    def delete(self, condition: Column) -> None:
        """Takes the keys of meta for which the condition holds out of what is read."""
        gone = self.meta().where(condition).withColumns({"status": F.lit("deleted"), "updated_at": F.current_timestamp(), "logged_at": F.current_timestamp()})
        gone.write.mode("append").parquet(f"{self.path}/meta")

    def delete_expired(self, ttl_s: int = SNAPSHOT_TTL_S) -> None:
        self.delete(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("updated_at") > ttl_s)

    def compact(self) -> str | None:
        """Puts all current rows into one generation, in ranges of the key and sorted, so that reads of some keys skip files and row groups. Times of update stay. The generation's name; None for an empty store."""
        known = self.meta()
        if known.limit(1).count() == 0:
            return None
        generation = uuid.uuid4().hex
        rows = self.read()
        rows.repartitionByRange("interval", "symbol", "ts").sortWithinPartitions("interval", "symbol", "ts").write.option("compression", "lz4_raw").partitionBy("interval").parquet(f"{self.path}/data/generation={generation}")
        entry = known.withColumns({"generation": F.lit(generation), "logged_at": F.current_timestamp()}).select(*[c.split()[0] for c in META.split(", ")])
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/meta")
        return generation

    def vacuum(self, older_s: int = 3600) -> list[str]:
        """Deletes the generations that no key is read from and that were written so long ago, longer than any read takes. Their names."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        used = {r.generation for r in self.meta().select("generation").distinct().collect()}
        now = self.spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
        gone = []
        for f in files.listStatus(path):
            name = f.getPath().getName().partition("generation=")[2]
            if name and name not in used and f.getModificationTime() <= now - 1000 * older_s:
                files.delete(f.getPath(), True)
                gone.append(name)
        return gone

    def health(self) -> DataFrame:
        """interval, keys, rows, oldest and newest update."""
        return self.meta().groupBy("interval").agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest"))


def load_setup(spark: SparkSession, path: str) -> DataFrame:
    """Saved choices: symbols, intervals, indicators."""
    return spark.read.schema("symbols array<string>, intervals array<string>, indicators array<string>").json(path)


def save_setup(setup: DataFrame, path: str) -> None:
    setup.coalesce(1).write.mode("overwrite").json(path)
