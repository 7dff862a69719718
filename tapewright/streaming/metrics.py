"""What streams do, as a table: rows and rejected messages of each micro-batch, rates, and how old the newest row is."""

from __future__ import annotations

import threading
import time
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

METRICS = "query string, batch long, at string, rows long, in_per_s double, out_per_s double, judged long, rejected long, newest timestamp"
OBSERVED = "messages"
#: Micro-batches that a log remembers.
KEPT = 10_000


def observed(rows: DataFrame, rejected: Column, at: Column) -> DataFrame:
    """The same rows; each micro-batch tells how many there are, for how many `rejected` holds, and the newest time. Counted where the rows pass, at no extra pass."""
    return rows.observe(OBSERVED, F.count(F.lit(1)).alias("judged"), F.count_if(F.coalesce(rejected, F.lit(False))).alias("rejected"), F.max(at).alias("newest"))


class MetricsLog(StreamingQueryListener):
    """Remembers the progress of the session's streams, the last KEPT micro-batches; `table` has them as rows. A batch that runs again after a restart counts once, by its last run."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._rows = spark, threading.Lock(), deque(maxlen=KEPT)
        spark.streams.addListener(self)

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def wait(self, query: StreamingQuery, timeout_s: float = 30.0) -> None:
        """Returns when the log has the last micro-batch of a stream: Spark tells of progress a little later than it happens."""
        end = time.monotonic() + timeout_s
        while (last := query.lastProgress) and time.monotonic() < end:
            with self._lock:
                if any(r[:2] == (str(query.id), int(last["batchId"])) for r in self._rows):
                    return
            time.sleep(0.05)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        own = p.observedMetrics.get(OBSERVED)
        seen = (own["judged"], own["rejected"], own["newest"]) if own is not None else (None, None, None)
        with self._lock:
            self._rows.append((str(p.id), int(p.batchId), p.timestamp, int(p.numInputRows), float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0), *seen))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self) -> DataFrame:
        """METRICS, a row for each query and micro-batch."""
        with self._lock:
            rows = list({(r[0], r[1]): r for r in self._rows}.values())
        return self.spark.createDataFrame(rows, METRICS)


def staleness(metrics: DataFrame, now, limit_s: float) -> DataFrame:
    """query, newest, age_s and stale for each query of a metrics table: stale if its newest row is older than the limit, or it has none."""
    newest = metrics.groupBy("query").agg(F.max("newest").alias("newest"))
    age = F.lit(now).cast("timestamp").cast("double") - F.col("newest").cast("double")
    return newest.withColumn("age_s", age).withColumn("stale", F.coalesce(F.col("age_s") > limit_s, F.lit(True)))
