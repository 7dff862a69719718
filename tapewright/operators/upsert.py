"""A table that streams upsert into, exactly once: versions by batch number, merged on read, with a feed of changes.

A micro-batch writes the folder of its own number, so a batch that runs again after a failure puts the same rows into
the same place. Readers take the newest version of each key. Compaction writes the merged rows as a base under the
number that they go up to; a base is used once its marker is there, and vacuum then takes away what it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.bars import keep_last


class UpsertTable:
    """Rows by key under one path that all executors reach. Every batch has the same columns."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the finished versions or bases, in order."""
        if not self._fs.exists(self._at(kind)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(kind))]
        return sorted(int(x.partition("=")[2]) for x in names if "=" in x and self._fs.exists(self._at(kind, x, "_SUCCESS")))

    def _rows(self, below: int | None = None) -> DataFrame | None:
        """All kept rows with _version, newest base and the versions after it; of those below a number, if given."""
        within = lambda n: below is None or n < below
        base = max(filter(within, self.numbers("bases")), default=None)
        parts = [] if base is None else [self.spark.read.parquet(f"{self.path}/bases/n={base}")]
        for n in self.numbers("versions"):
            if within(n) and (base is None or n > base):
                parts.append(self.spark.read.parquet(f"{self.path}/versions/n={n}").withColumn("_version", F.lit(n).cast("long")))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def read(self, below: int | None = None) -> DataFrame | None:
        """The newest row of each key (as it was before batch `below`); None for a table without rows."""
        rows = self._rows(below)
        return None if rows is None else keep_last(rows, "_version", self.key).drop("_version")

    def write(self, rows: DataFrame, batch: int, order: str | None = None) -> None:
        """Upserts a micro-batch, and writes what it changes to the feed. Of several rows of a key the last by `order` counts. For foreachBatch.

        A batch that was written in full is not written again. The feed is worked out against the rows of earlier
        batches, so it too is the same however often a batch runs.
        """
        if batch in self.numbers("versions") or batch <= max(self.numbers("bases"), default=-1):
            return
        new = rows if order is None else keep_last(rows.withColumn("_order", F.col(order)), "_order", self.key).drop("_order")
        new = new.persist()
        try:
            old = self.read(below=batch)
            self._changes(new, old).write.mode("overwrite").parquet(f"{self.path}/changes/n={batch}")
            new.write.mode("overwrite").parquet(f"{self.path}/versions/n={batch}")
        finally:
            new.unpersist()

    def _changes(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        rest = [c for c in new.columns if c not in self.key]
        after = F.struct(*[F.col(f"n.`{c}`").alias(c) for c in rest])
        key = [F.col(f"n.`{c}`").alias(c) for c in self.key]
        if old is None:
            return new.alias("n").select(*key, F.lit("insert").alias("op"), F.lit(None).cast(new.select(F.struct(*rest)).schema[0].dataType).alias("before"), after.alias("after"))
        same: Column = F.lit(True)
        for c in self.key:
            same = same & F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
        joined = new.alias("n").join(old.withColumn("_there", F.lit(True)).alias("o"), same, "left")
        before = F.when(F.col("_there"), F.struct(*[F.col(f"o.`{c}`").alias(c) for c in rest]))
        both = joined.select(*key, F.when(F.col("_there"), "update").otherwise("insert").alias("op"), before.alias("before"), after.alias("after"))
        return both.where(~F.col("before").eqNullSafe(F.col("after")))

    def changes(self, since: int = -1) -> DataFrame | None:
        """key, op (insert or update), before, after and batch of each change after a batch number."""
        out = None
        for n in self.numbers("changes"):
            if n > since:
                part = self.spark.read.parquet(f"{self.path}/changes/n={n}").withColumn("batch", F.lit(n).cast("long"))
                out = part if out is None else out.unionByName(part)
        return out

    def compact(self) -> int | None:
        """Merges all versions so far into a base and returns its number. Readers go on with what they have."""
        done = self.numbers("versions")
        bases = self.numbers("bases")
        if not done or (bases and bases[-1] >= done[-1]):
            return bases[-1] if bases else None
        # dealt out and sorted by key, so that reads of some keys skip row groups
        rows = keep_last(self._rows(below=done[-1] + 1), "_version", self.key)
        rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write.mode("overwrite").parquet(f"{self.path}/bases/n={done[-1]}")
        return done[-1]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes versions and bases that the newest `keep` bases stand for; reads that began before the last `keep` compactions must be over. Changes stay."""
        bases = self.numbers("bases")
        if len(bases) < keep:
            return []
        oldest = bases[-keep]
        gone = [f"versions/n={n}" for n in self.numbers("versions") if n <= oldest] + [f"bases/n={n}" for n in bases if n < oldest]
        for x in gone:
            self._fs.delete(self._at(*x.split("/")), True)
        return gone
