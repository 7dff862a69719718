"""Streams under splits and restarts: keyed state, timers, chained windows, and the table that streams upsert into."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions.indicators import indicators
from tapewright.functions.stepwise import OUTPUTS, Series
from tapewright.operators.upsert import UpsertTable
from tapewright.plans.dims import BAR
from tapewright.plans.registry import ORACLES, QUERIES
from tapewright.sources import files
from tapewright.streaming import live, metrics, stateful

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)
NAMES = ["RSI", "ADX", "EMA", "MCD", "SMI", "ADO", "OBV", "CVD", "VWAP", "SMA_20", "SMA_50", "SMA_200", "BOL", "RSM", "TRP", "MFI", "CMF", "CCI", "WIL", "STOCH", "VOL", "VRT", "FRC"]
COLUMNS = ["kind", "ts", "open", "high", "low", "close", "volume", "seq"]


def bar_rows(n, seed=1, interval="4h"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        close = 100 + 10 * math.sin(i / 7) + rng.random()
        first = close + rng.uniform(-2, 2)
        out.append(("s", interval, T0 + datetime.timedelta(hours=4 * i), first, max(first, close) + rng.random(), min(first, close) - rng.random(), close, float(rng.randrange(50))))
    return out


@pytest.mark.parametrize("name", ["stream_incremental_indicators", "stream_live_expiry", "stream_chained_bars", "stream_upsert_table", "stream_change_feed", "stream_snapshot_replace", "stream_metrics", "message_files_of_two_sources"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    value = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    got = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(map(value, r)) for r in got.select(*[F.col(f"`{c}`") for c in names]).collect()), key=str) == sorted((tuple(map(value, r)) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("records", ["3", "10000"])
def test_a_snapshot_in_two_files_and_many_chunks_keeps_all_its_bars(spark, tmp_path, records):
    rows = bar_rows(12)
    seq = lambda rows, n: spark.createDataFrame(rows, BAR).withColumn("seq", F.lit(n))
    parts = [live.events(bars=seq(rows[:9], 1)), live.events(snapshots=seq(rows[2:6], 5)), live.events(snapshots=seq(rows[6:8], 5), bars=seq(rows[:2], 2)), live.events(bars=seq(rows[8:], 9), snapshots=seq(rows[:1], 4))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in")
            live.serve(live.live_windows(stream), lambda df, i: df.withColumn("n", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.where(F.col("n") == out.agg(F.max("n")).first()[0]).orderBy("ts").collect()
    # the older snapshot and the older bars have no effect, nor do bars of the first batch come back
    assert [r.close for r in last] == [r[6] for r in rows[2:]]


def test_events_do_not_pass_newer_ones_and_bars_wait_for_a_snapshot():
    n, at = float("nan"), [pd.Timestamp(T0) + pd.Timedelta(hours=i) for i in range(3)]
    bar = lambda t, close, seq, kind="bar": [kind, t, 1.0, 2.0, 0.5, close, 1.0, seq]
    seen: dict = {}
    kept = live.apply_events([], pd.DataFrame([bar(at[0], 1.0, 5), ["tick", pd.NaT, n, n, n, 7.0, n, 8]], columns=COLUMNS), seen=seen)
    again = live.apply_events(kept, pd.DataFrame([bar(at[0], 3.0, 6), ["patch", pd.NaT, n, n, n, 9.0, n, 7]], columns=COLUMNS), seen=seen)
    assert again[0][4] == 7.0 and again[0][2] == 7.0
    seen = {}
    assert live.apply_events([], pd.DataFrame([bar(at[0], 1.0, 1)], columns=COLUMNS), seen=seen, gated=True) == []
    kept = live.apply_events([], pd.DataFrame([bar(at[1], 1.0, 3), bar(at[0], 4.0, 2, "snapshot")], columns=COLUMNS), seen=seen, gated=True)
    assert [b[0] for b in kept] == at[:2]


def test_stepwise_indicators_are_those_of_the_batch(spark):
    rows = bar_rows(260) + [(*r[:2], r[2] + datetime.timedelta(days=60), 5.0, 5.0, 5.0, 5.0, 0.0) for r in bar_rows(40)]
    wanted = indicators(spark.createDataFrame(rows, BAR), NAMES).orderBy("ts").collect()
    series = Series("4h")
    for row, want in zip(rows, wanted, strict=True):
        got = series.step(int(row[2].replace(tzinfo=datetime.UTC).timestamp() * 1e6), *row[3:])
        for c in OUTPUTS:
            assert got.get(c) is None if want[c] is None else got[c] == pytest.approx(want[c], rel=1e-7, abs=1e-6), (c, row[2])
    assert sum(len(v) for v in series.state.values() if isinstance(v, list)) < 700


def test_incremental_indicators_go_on_from_their_checkpoint(spark, tmp_path):
    """More bars than any window, fed in parts with forming bars, ticks and late bars between them."""
    rows = bar_rows(420)
    frame = lambda part, seq: spark.createDataFrame(part, BAR).withColumn("seq", F.lit(seq))
    half = [(*rows[200][:3], 50.0, 60.0, 40.0, 55.0, 1.0)]
    ticks = spark.createDataFrame([("s", 61.0, 2), ("s", 45.0, 2)], "symbol string, price double, seq long")
    parts = [live.events(bars=frame(rows[:200], 0)), live.events(bars=frame(half, 1), ticks=ticks, intervals=["4h"]), live.events(bars=frame(rows[200:300], 3).union(frame(rows[5:6], 3))), live.events(bars=frame(rows[300:], 4))]
    for part in parts:
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in")
        live.serve(stateful.incremental_indicators(stream), lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("ts", "seq").collect()
    assert [r.ts for r in got] == [rows[i][2] for i in (199, 200, 299, 419)] and [r.late for r in got] == [0, 0, 1, 1]
    assert got[1].high == 61.0 and got[1].low == 40.0 and got[1].close in (61.0, 45.0)
    want = indicators(spark.createDataFrame(rows, BAR), NAMES).orderBy(F.desc("ts")).first()
    for c in OUTPUTS:
        assert got[-1][c] == pytest.approx(want[c], rel=1e-7, abs=1e-6), c


def test_silent_keys_expire_by_the_timer_after_a_restart(spark, tmp_path):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    parts = [[("a", "4h", at(0), 1.0), ("b", "4h", at(10), 2.0)], [("b", "4h", at(90), 3.0), ("a", "4h", at(5), 9.0)], [("c", "1m", at(130), 4.0), ("x", "?", at(131), 1.0)], [("c", "1m", at(400), 5.0)]]
    kind = "symbol string, interval string, at timestamp, price double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        live.serve(stateful.expiring_rows(stream, "20 seconds"), lambda df, i, k=k: df.withColumn("part", F.lit(k)).write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").where("status = 'expired'").collect()
    # a's last row is that of second 5, b's of second 90; each goes 120 s later, c after 10 s, an unknown width after 30
    assert sorted((r.symbol, r.price, (r.expires_at - T0).total_seconds()) for r in rows) == [("a", 9.0, 125.0), ("b", 3.0, 210.0), ("c", 4.0, 140.0), ("x", 1.0, 161.0)]
    assert all(r.part >= 2 for r in rows)


def test_late_ticks_of_chained_windows_are_counted(spark, tmp_path):
    kind = "symbol string, ts timestamp, id long, price double, size double"
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    dropped = 0
    for part in ([("s", at(1), 1, 1.0, 1.0), ("s", at(70), 2, 2.0, 1.0)], [("s", at(300), 3, 3.0, 1.0)], [("s", at(20), 4, 9.0, 1.0), ("s", at(900), 5, 4.0, 1.0)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        query = live.serve(live.chained_bars(stream, ("15m", "1h", "4h"), "10 minutes"), lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state", mode="append")
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()
    assert [(r.ts, r.open, r.close, r.volume) for r in rows] == [(at(0), 1.0, 2.0, 2.0), (at(240), 3.0, 3.0, 1.0)] and dropped == 1


def test_a_batch_again_changes_nothing_and_vacuum_keeps_what_is_read(spark, tmp_path):
    kept = UpsertTable(spark, f"{tmp_path}/t", ("k",))
    frame = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    seen = lambda: sorted(map(tuple, kept.read().collect()))
    assert kept.read() is None and kept.changes() is None and kept.compact() is None and kept.vacuum() == []
    kept.write(frame((1, 1), (2, 2), (None, 0)), 0)
    kept.write(frame((2, 3), (3, 3), (1, 1)), 1)
    # a batch that died between feed and rows: the feed is there, its rows aren't
    kept._fs.delete(kept._at("versions", "n=1"), True)
    kept.write(frame((2, 3), (3, 3), (1, 1)), 1)
    kept.write(frame((2, 99)), 1)
    assert sorted((r.k, r.v) for r in kept.read().where("k IS NOT NULL").collect()) == [(1, 1), (2, 3), (3, 3)] and kept.read().count() == 4
    feed = [(r.batch, r.k, r.op, r.before and r.before.v, r.after.v) for r in kept.changes().where("k IS NOT NULL").collect()]
    assert sorted(feed) == [(0, 1, "insert", None, 1), (0, 2, "insert", None, 2), (1, 2, "update", 2, 3), (1, 3, "insert", None, 3)]
    reader = kept.read()
    assert kept.compact() == 1 == kept.compact()
    assert reader.count() == 4 == kept.read().count()
    kept.write(frame((2, 7), (2, 8)).withColumn("v", F.col("v")), 2, order="v")
    assert sorted(kept.vacuum()) == ["versions/n=0", "versions/n=1"]
    assert [r.v for r in kept.read().where("k = 2").collect()] == [8] and kept.read().count() == 4
    kept.write(frame((2, 99)), 0)
    assert [r.v for r in kept.read().where("k = 2").collect()] == [8] and kept.changes(since=1).count() == 1


def test_metrics_tell_of_silent_streams(spark):
    rows = [("q", 0, "t", 5, 1.0, 1.0, 5, 1, T0), ("q", 1, "t", 0, 0.0, 0.0, 0, 0, None), ("r", 0, "t", 1, 1.0, 1.0, None, None, None)]
    got = {r["query"]: (r.age_s, r.stale) for r in metrics.staleness(spark.createDataFrame(rows, metrics.METRICS), T0 + datetime.timedelta(seconds=9), 8).collect()}
    assert got == {"q": (9.0, True), "r": (None, True)}
    assert not metrics.staleness(spark.createDataFrame(rows[:1], metrics.METRICS), T0 + datetime.timedelta(seconds=8), 8).first().stale


def test_message_files_prune_folders_and_are_read_once_by_a_stream(spark, tmp_path):
    raw = spark.createDataFrame([(f'{{"t":"mexc_deal","symbol":"{s}","price":{p}}}', s, i) for s, i, p in (("a", "1m", 1), ("b", "1m", 2), ("a", "1h", 3))], "value string, symbol string, interval string")
    files.write_messages(raw, f"{tmp_path}/in")
    one = files.read_messages(spark, f"{tmp_path}/in", ["a"], ["1h"])
    assert [r.value for r in one.collect()] == ['{"t":"mexc_deal","symbol":"a","price":3}']
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(symbol#" in plan.partition("PartitionFilters")[2].partition("PushedFilters")[0]
    for _ in range(2):
        live.serve(files.read_messages(spark, f"{tmp_path}/in", stream=True), lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state", mode="append").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
