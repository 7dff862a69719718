"""Streams: closed bars by event time, and forming bars that are kept up to date by key.

The batch definitions are used throughout; a finished stream gives the rows of a batch run over the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewright.functions.indicators import indicators
from tapewright.operators.serving import latest
from tapewright.plans.dims import HEAVY_SET, KEY, STALE_S, WIDTHS, by_interval

#: Bars that the live state keeps of each key where only the forming bar is wanted; later events for older bars are too late.
KEPT_BARS = 3
EVENT = "symbol string, interval string, kind string, ts timestamp, open double, high double, low double, close double, volume double, seq long"
LIVE = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double, seq long"
_PRICES = ["open", "high", "low", "close", "volume"]


def tumbling_bars(ticks: DataFrame, interval: str, late: str = "1 day") -> DataFrame:
    """Closed bars of a stream of ticks (symbol, ts TIMESTAMP, id, price, size); ticks later than `late` are left out.

    Partial sums per task and state per (symbol, bucket); a bar is given out once the watermark has passed its end.
    """
    order = F.struct("ts", "id")
    start = F.window("ts", f"{WIDTHS[interval].seconds} seconds")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", start.alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("ts"), *_PRICES)


def chained_bars(ticks: DataFrame, intervals: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """Closed bars of the last of the intervals from a stream of ticks, each width built from the one before, in append mode.

    One stream with an aggregation for each width. The watermark goes through all of them: a bar is given out once, when
    it has passed the bar's end, and its state goes. Ticks later than `late` are left out and counted by Spark
    (numRowsDroppedByWatermark). Each width must be a multiple of the one before.
    """
    order = F.struct("ts", "id")
    first = F.window("ts", f"{WIDTHS[intervals[0]].seconds} seconds").alias("w")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", first).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    for interval in intervals[1:]:
        at = F.col("w.start")
        wider = (F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
        bars = bars.groupBy("symbol", F.window("w", f"{WIDTHS[interval].seconds} seconds").alias("w2")).agg(*wider).withColumnRenamed("w2", "w")
    return bars.select("symbol", F.lit(intervals[-1]).alias("interval"), F.col("w.start").alias("ts"), *_PRICES)


def events(bars: DataFrame | None = None, ticks: DataFrame | None = None, patches: DataFrame | None = None, intervals: list[str] | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """One event form of bars (kind bar), ticks (kind tick, for each of the intervals), price patches (kind patch) and bars of whole snapshots (kind snapshot).

    Bars of a poll are of kind bar: they only add to what is known. The bars of one snapshot share their seq.

    Each may have a column seq that puts the events of a key in order; without it they are in no order within a batch.
    """

    def form(df: DataFrame, kind: str) -> DataFrame:
        have = {"close": "price"} if kind in ("tick", "patch") else {}
        column = lambda c, t: F.col(have.get(c, c)).cast(t) if have.get(c, c) in df.columns else F.lit(None).cast(t)
        kinds = [x.split() for x in EVENT.split(", ")]
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else (F.coalesce(column(c, t), F.lit(0)) if c == "seq" else column(c, t)).alias(c) for c, t in kinds])

    parts = []
    if bars is not None:
        parts.append(form(bars, "bar"))
    if snapshots is not None:
        parts.append(form(snapshots, "snapshot"))
    if ticks is not None:
        every = F.explode(F.array(*[F.lit(i) for i in intervals or WIDTHS]))
        parts.append(form(ticks.withColumn("interval", every), "tick"))
    if patches is not None:
        parts.append(form(patches, "patch"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_events(kept: list[list], rows: pd.DataFrame, most: int = KEPT_BARS, seen: dict | None = None, gated: bool = False) -> list[list]:
    """The newest `most` bars [ts, open, high, low, close, volume] after the events, in the order of seq.

    A bar replaces the one of its ts, or is put in its place; those behind the kept ones are too late. The bars of a
    snapshot, which share their seq, replace all that came before, in however many parts they come. A tick moves the last
    bar's close, high and low; a patch only its close; both do nothing before there is a bar. gated: neither does a bar
    before the first snapshot.

    seen keeps the seq of each bar and of the snapshot between calls: what is older than the bar or snapshot that it
    would change does nothing, so events may come late or twice.
    """
    seen = {} if seen is None else seen
    bars = {b[0]: b for b in kept}
    for e in rows.sort_values(["seq", "ts"], kind="stable").itertuples(index=False):
        snapshot = seen.get("snapshot")
        if e.kind in ("bar", "snapshot"):
            if e.kind == "snapshot" and (snapshot is None or e.seq > snapshot):
                bars = {t: b for t, b in bars.items() if seen.get(t, 0) > e.seq}
                seen["snapshot"] = snapshot = e.seq
            if e.seq < max(seen.get(e.ts, 0), snapshot or 0) or (gated and snapshot is None):
                continue
            if len(bars) < most or e.ts >= min(bars):
                bars[e.ts], seen[e.ts] = [e.ts, e.open, e.high, e.low, e.close, e.volume], e.seq
                while len(bars) > most:
                    del bars[min(bars)]
        elif bars and e.seq >= seen.get(max(bars), 0):
            own = bars[max(bars)]
            own[4], seen[own[0]] = e.close, e.seq
            if e.kind == "tick":
                own[2], own[3] = max(own[2], e.close), min(own[3], e.close)
    for t in [t for t in seen if t != "snapshot" and t not in bars]:
        del seen[t]
    return [bars[t] for t in sorted(bars)]


def gathered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All of a key's rows of a micro-batch: Spark hands them over in chunks that may cut anywhere."""
    return pd.concat(list(batches), ignore_index=True)


def _live(whole: bool, gated: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Gives out a key's forming bar, or all bars of its width's window."""

    def live(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        width = WIDTHS.get(key[1])
        most = KEPT_BARS if not whole else width.window if width else 200
        kept, seen, seq = [], {}, 0
        if state.exists:
            bars, seq, snapshot = state.get
            kept = [[pd.Timestamp(t), *v[:-1]] for t, *v in bars]
            seen = {pd.Timestamp(t): int(v[-1]) for t, *v in bars} | ({} if snapshot is None else {"snapshot": snapshot})
        rows = gathered(batches)
        kept = apply_events(kept, rows, most, seen, gated)
        seq = max(seq, int(rows["seq"].max()))
        if kept or "snapshot" in seen:
            state.update(([[b[0].to_datetime64().astype("datetime64[us]").astype(object), *map(float, b[1:]), int(seen.get(b[0], 0))] for b in kept], seq, seen.get("snapshot")))
        if kept:
            yield pd.DataFrame([[*key, *b, seq] for b in (kept if whole else kept[-1:])], columns=["symbol", "interval", "ts", *_PRICES, "seq"])

    return live


_STATE = "bars array<struct<ts:timestamp,open:double,high:double,low:double,close:double,volume:double,seq:long>>, seq long, snapshot long"


def live_rows(events: DataFrame, gated: bool = False) -> DataFrame:
    """A stream of each touched key's forming bar, one row in a micro-batch, from a stream of events (EVENT).

    State of a key: KEPT_BARS bars. Keys are dealt out by hash, so events of a key meet in one place in each batch.
    """
    return events.groupBy(*KEY).applyInPandasWithState(_live(False, gated), LIVE, _STATE, "update", GroupStateTimeout.NoTimeout)


def live_windows(events: DataFrame, gated: bool = False) -> DataFrame:
    """The same with all bars of each touched key's window (at most 300, by its width), from which live_indicators follow."""
    return events.groupBy(*KEY).applyInPandasWithState(_live(True, gated), LIVE, _STATE, "update", GroupStateTimeout.NoTimeout)


def live_indicators(windows: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """The newest row of each key of a micro-batch of live_windows, with the indicators less those that the live path leaves out (HEAVY_SET).

    They are the batch indicators over the window, so what looks further back than that begins with it.
    """
    return latest(indicators(windows, [n for n in names if n not in HEAVY_SET]))


def _gated(gap_s: float | None, heavy: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        width = WIDTHS.get(key[1])
        gap = gap_s if gap_s is not None else (width.heavy_throttle_s if heavy else width.throttle_s) if width else 2.0
        last = state.get[0] if state.exists else None
        rows, kept = gathered(batches), []
        for i, at in rows["at"].sort_values(kind="stable").items():
            if last is None or at.timestamp() - last >= gap:
                last = at.timestamp()
                kept.append(i)
        yield rows.loc[kept]
        if last is not None:
            state.update((last,))

    return gate


def throttled(rows: DataFrame, heavy: bool = False, gap_s: float | None = None) -> DataFrame:
    """Of a stream of rows (key, `at` TIMESTAMP and others) those of each key that are a gap or more behind the last one given out.

    The gap is by width (heavy: the composite's), or gap_s seconds for all. State of a key: one time.
    """
    return rows.groupBy(*KEY).applyInPandasWithState(_gated(gap_s, heavy), rows.schema, "last double", "update", GroupStateTimeout.NoTimeout)


def due(rows: DataFrame, emitted: DataFrame, now, heavy: bool = False) -> DataFrame:
    """The rows of the keys whose width's throttle has passed since they were given out last. emitted: key and emitted_at."""
    gap = by_interval({k: float(w.heavy_throttle_s if heavy else w.throttle_s) for k, w in WIDTHS.items()})
    at = F.lit(now).cast("timestamp").cast("double")
    joined = rows.join(emitted.select(*KEY, "emitted_at"), list(KEY), "left")
    return joined.where(F.coalesce(at - F.col("emitted_at").cast("double") >= gap, F.lit(True))).drop("emitted_at")


def with_ttl(rows: DataFrame, now) -> DataFrame:
    """Live rows with expires_at, by their width."""
    ttl = by_interval({k: w.live_ttl_s for k, w in WIDTHS.items()})
    return rows.withColumn("expires_at", F.timestamp_seconds(F.lit(now).cast("timestamp").cast("double") + ttl))


def unexpired(rows: DataFrame, now) -> DataFrame:
    return rows.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def serve(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "update") -> StreamingQuery:
    """Runs a stream into a function of (rows, batch number): at intervals, or over all there is and then ends. Stop by query.stop().

    State is kept in RocksDB, outside the executors' heaps; transformWithState needs that too. A stream takes the setting
    when it starts, so the session gets its own back.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.set(STATE_STORE, before)


def rates(query: StreamingQuery) -> dict[str, float]:
    """Input and processed rows a second, and the rows of the last batch."""
    p = query.lastProgress
    return {"in_per_s": float(p["inputRowsPerSecond"] or 0), "out_per_s": float(p["processedRowsPerSecond"] or 0), "rows": float(p["numInputRows"])} if p else {"in_per_s": 0.0, "out_per_s": 0.0, "rows": 0.0}


def stale(updated, now, limit_s: int = STALE_S):
    """Whether a heartbeat is too old."""
    return (F.lit(now).cast("timestamp").cast("double") - updated.cast("double")) > limit_s
