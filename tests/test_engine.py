"""The market engine: queries against SQL, and hand-made series for what SQL doesn't say."""

import datetime
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright.functions import divergence, native, tpd
from tapewright.functions.consensus import consensus
from tapewright.functions.indicators import indicators
from tapewright.functions.recursive import seeded
from tapewright.operators import reports, serving, store
from tapewright.operators.bars import derive, keep_last, merge_poll, resample
from tapewright.operators.blocks import blocked, finished, recurrences, running_sum
from tapewright.operators.quantile import exact_quantile
from tapewright.plans.dims import BAR, DEFAULT_SET, PRESETS, matching_preset
from tapewright.plans.registry import ORACLES, QUERIES
from tapewright.sources import messages as msg
from tapewright.streaming import live

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)
CHECKED = ["bars_resample_4h", "bars_derived_3d", "ind_mfi", "ind_rsi", "ind_adx_di", "ind_smi", "ind_cci", "ind_net_volume", "ind_vortex", "kns_trend", "tpd_score", "tpd_signals", "tpd_strength", "tpd_metrics", "tpd_recommendation", "swing_points", "divergence_consensus", "ind_divergence_simple", "nearest_asof_tolerance", "upsert_poll_merge", "stream_live_upsert"]


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = comparable(df.columns, df.collect())
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == comparable(names, found.fetchall())


def test_events_without_a_price_above_0_count_in_the_places_of_nearest(spark, tmp_path):
    con, minute = duckdb.connect(), lambda i: T0 + datetime.timedelta(minutes=7 * i)
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    values = [480.0, None, 0.0, -3.0, 20.0, 0.0, 475.0, *[50.0] * 9, None, 5.0, 471.0, 0.5]
    rows = [(i, minute(i), t, v, "{}") for t in ("a", "b", None) for i, v in enumerate(values)]
    rows += [(98, None, "a", 490.0, "{}"), (99, None, "a", 1.0, "{}"), (None, minute(3), "b", 472.0, "{}")]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["nearest_asof_tolerance"](spark, str(tmp_path))
    want = con.execute(ORACLES["nearest_asof_tolerance"]).fetchall()
    assert len(want) > 6 and comparable(df.columns, df.collect()) == comparable(["symbol", "place", "other"], want)


def bars_of(spark, closes, interval="4h", volume=10.0, start=T0, symbol="s", spread=0.0):
    rows = [(symbol, interval, start + datetime.timedelta(hours=4 * i), float(c), float(c) + spread, float(c) - spread, float(c), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def test_flat_prices_give_no_nan_and_neutral_values(spark):
    rows = indicators(bars_of(spark, [5.0] * 60), [*DEFAULT_SET, "Fibonacci", "STOCH"]).orderBy("ts").collect()
    last = rows[-1].asDict()
    assert len(rows) == 60 and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
    assert last["RSI"] == 0 and last["RSM"] == 0 and last["WIL"] == 0 and last["CCI"] == 0 and last["TRP"] == 0 and last["Net_Volume"] == 0
    assert last["Fib_500"] is None and last["SR_SIGNAL"] == "neutral" and last["COMBINED_TREND_SIGNAL"] == "WAIT"
    assert rows[0]["SMA_20"] is None and last["SMA_20"] == 5.0 and last["OBV"] == 600.0


def test_rising_prices_saturate(spark):
    last = indicators(bars_of(spark, range(1, 61), spread=0.5), ["RSI", "RSM", "ADX", "MFI", "TRP", "OBV"]).orderBy(F.desc("ts")).first()
    assert last["RSI"] == 100 and last["TRP"] == 100 and last["ADX"] == pytest.approx(100) and last["MFI"] == pytest.approx(100)
    assert last["RSM"] == pytest.approx(100 - 100 / 2) and last["OBV"] == 600


def test_row_order_and_blocks_do_not_matter(spark):
    rng = random.Random(3)
    closes = [100 + 10 * math.sin(i / 5) + rng.random() for i in range(700)]
    whole = indicators(bars_of(spark, closes, spread=0.3), ["RSI", "SMA_20", "OBV", "CVD", "MCD", "CCI", "VOL"]).orderBy("ts").collect()
    cut = indicators(bars_of(spark, closes, spread=0.3).orderBy(F.rand(1)), ["RSI", "SMA_20", "OBV", "CVD", "MCD", "CCI", "VOL"], rows=450, halo=440).orderBy("ts").collect()
    assert len(cut) == 700
    for a, b in zip(whole, cut, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, rel=1e-6, abs=1e-5) if isinstance(x, float) else x == y


def test_running_sum_over_many_blocks(spark):
    df = blocked(bars_of(spark, range(1, 101)), rows=7, halo=3)
    out = finished(running_sum(df, {"total": "close"})).orderBy("ts").collect()
    assert [r.total for r in out] == [i * (i + 1) / 2 for i in range(1, 101)]


def test_fill_carries_over_blocks(spark):
    rows = blocked(bars_of(spark, range(1, 41)), 10, 3).withColumn("x", F.when(F.col("_rn") == 4, 4.0))
    got = {r.close: r.x for r in finished(native.filled(rows, ["x"])).collect()}
    assert got == {float(i): 0.0 if i < 4 else 4.0 for i in range(1, 41)}


def test_empty_bars_give_empty_results(spark):
    empty = spark.createDataFrame([], BAR)
    assert indicators(empty, DEFAULT_SET).count() == 0
    assert divergence.divergence_consensus(indicators(empty, divergence.SWING_INDICATORS)).count() == 0
    assert reports.backtest(indicators(empty, ["TRD"])).count() == 0


def test_resample_ties_and_derive(spark):
    ticks = spark.createDataFrame([("s", T0, 2, 3.0, 1.0), ("s", T0, 1, 2.0, 1.0), ("s", T0 + datetime.timedelta(hours=5), 3, 9.0, 4.0)], "symbol string, ts timestamp, id long, price double, size double")
    rows = resample(ticks, "1h").orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in rows] == [(2.0, 3.0, 2.0), (9.0, 9.0, 4.0)]
    six = derive(resample(ticks, "1h"), "6h").collect()
    assert len(six) == 1 and (six[0].open, six[0].high, six[0].close, six[0].volume) == (2.0, 9.0, 9.0, 6.0)


def test_merge_poll_and_keep_last(spark):
    base = bars_of(spark, [1, 2])
    new = spark.createDataFrame([("s", "4h", T0, None, None, None, 7.0, None), ("s", "4h", T0 + datetime.timedelta(days=9), 1.0, 1.0, 1.0, 1.0, 1.0)], BAR)
    out = {r.ts: r for r in merge_poll(base, new).collect()}
    assert len(out) == 3 and out[T0].close == 7.0 and out[T0].open == 1.0
    twice = base.withColumn("n", F.lit(1)).unionByName(base.withColumns({"n": F.lit(2), "close": F.lit(0.0)}))
    assert {r.close for r in keep_last(twice, "n").collect()} == {0.0}


def test_votes_fall_back_where_columns_are_null(spark):
    row = bars_of(spark, [5.0]).withColumns({"Net_Volume_Z": F.lit(None).cast("double"), "Net_Volume": F.lit(-3.0), "CVD_Mom": F.lit(2.0), "CVD_Slope": F.lit(None).cast("double"), "VWAP": F.lit(None).cast("double")})
    got = consensus(row, PRESETS["DEFAULT"]).first()
    assert got.kns_score == round((-2 + 1.8) / 5.3, 3) and (got.kns_buy, got.kns_sell, got.kns_neutral) == (1, 1, 1)
    assert consensus(row, ["DIV"]).first().kns_signal == "NO_DATA" and consensus(row, ["OBV", "unknown"]).first().kns_neutral == 2
    assert matching_preset(["VWAP", "VOL", "CVD"]) == "DEFAULT" and matching_preset(["WIL", "CCI", "SMI", "MFI", "RSI"]) == "MOMENTUM"


@pytest.mark.parametrize(("close", "wanted"), [(100.0, "resistance"), (90.1, "support"), (96.0, "near_resistance"), (93.0, "near_support"), (None, "neutral")])
def test_sr_signal(spark, close, wanted):
    row = spark.range(1).select(native.sr_signal(F.lit(close).cast("double"), F.lit(90.0), F.lit(100.0)).alias("s")).first()
    assert row.s == wanted


def test_swings_are_spaced_and_never_at_the_ends(spark):
    closes = [50 + 10 * math.sin(i * math.pi / 10) for i in range(100)]
    own = divergence.swings(bars_of(spark, closes), "close").first()
    highs = [p.pos for p in own.highs]
    assert highs and all(closes[p] == pytest.approx(60) for p in highs) and all(b - a >= 12 for a, b in zip(highs, highs[1:], strict=False)) and min(highs) >= 50


def test_nearest_swing_prefers_the_earlier_of_two_and_keeps_its_distance(spark):
    points = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(float(p)).alias("value")) for p in (10, 14, 40)])
    got = spark.range(1).select(divergence.nearest(points, F.lit(12)).alias("a"), divergence.nearest(points, F.lit(25)).alias("b"), divergence.nearest(points, F.lit(50)).alias("c")).first()
    assert got.a.pos == 10 and got.b is None and got.c.pos == 40


def test_simple_divergence_marks_and_confidence(spark):
    cols = {c: F.when(F.col("close") == 1, 2.0).otherwise(1.0) for c, _ in divergence.SIMPLE}
    rows = finished(divergence.simple_divergence(blocked(bars_of(spark, [1, 2]).withColumns(cols)))).orderBy("ts").collect()
    assert rows[0].DIV == "➖" and rows[1].DIV.startswith("🟢M|🟢R") and rows[1].DIV.endswith("(H)")


def test_composite_of_a_flat_tail_has_neutral_values(spark):
    varied = bars_of(spark, [50 + 10 * math.sin(i / 3) + i % 4 for i in range(60)], spread=1.0)
    flat = bars_of(spark, [55.0] * 30, start=T0 + datetime.timedelta(hours=240))
    rows = tpd.tpd(varied.unionByName(flat)).orderBy("ts").collect()
    assert len(rows) == 90 and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r.asDict().values())
    assert rows[-1].TPD_Volatility_Factor == pytest.approx(0) and rows[-1].TPD_Strength >= 0


def test_a_reversal_of_the_other_side_weakens_a_signal(spark):
    raw = ["NEUTRAL", "MOMENTUM_REVERSAL_SELL", "NEUTRAL", "BUY", "NEUTRAL", "NEUTRAL", "NEUTRAL", "BUY"]
    rows = [("s", "4h", 0, i + 1, r, 0.0, "NO_DIVERGENCE") for i, r in enumerate(raw)]
    df = spark.createDataFrame(rows, "symbol string, interval string, _block int, _rn int, TPD_Raw_Signal string, TPD_Momentum double, TPD_Divergence string")
    df = df.withColumn("_chunk", F.lit(0))
    got = [r.s for r in df.select("_rn", tpd.confirmed(2).alias("s")).orderBy("_rn").collect()]
    assert got[3] == "WEAK_BUY" and got[7] == "BUY"


def test_divergence_shares_one_gathering_of_each_key(spark):
    plan = QUERIES["divergence_consensus"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 8 and plan.count("FlatMapGroupsInPandas") == 0


def test_message_decoders(spark):
    kline = {"t": "bnc_kline", "k": json.dumps({"s": "AUSDT", "i": "1m", "t": 1704067200000, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "9"})}
    arrays = {"t": "mexc_rest", "symbol": "B", "interval": "1h", "poll": True, "data": json.dumps({"time": [1704067200, 1704070800], "open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, 2], "vol": [3, 4]})}
    rows = {"t": "bnc_rest", "symbol": "C", "interval": "1h", "data": json.dumps([[1704067200000, "1", "2", "0.5", "1.5", "7", "x"]])}
    pushed = {"t": "mexc_kline", "symbol": "D", "interval": "1m", "kd": json.dumps({"t": 1704067200, "c": 4.0})}
    deal = {"t": "mexc_deal", "symbol": "B", "price": -1.0}
    raw = spark.createDataFrame([(json.dumps(m),) for m in (kline, arrays, rows, pushed, deal)] + [("not json",), (None,)], "value string")
    found = msg.messages(raw)
    got = sorted((r.symbol, r.interval, r.ts, r.open, r.close, r.volume) for r in msg.bars_of(found).collect())
    hour = datetime.timedelta(hours=1)
    assert got == [("AUSDT", "1m", T0, 1.0, 1.5, 9.0), ("B", "1h", T0, 1.0, 1.0, 3.0), ("B", "1h", T0 + hour, 2.0, 2.0, 4.0), ("C", "1h", T0, 1.0, 1.5, 7.0), ("D", "1m", T0, 4.0, 4.0, 0.0)]
    assert msg.deals(found).count() == 0
    frames = spark.createDataFrame([(json.dumps({"channel": "push.deal", "symbol": "btc_usdt", "data": [{"p": 1}, {"p": 2}]}),)], "value string")
    assert msg.deal_frames(frames).collect()[0].asDict() == {"symbol": "BTCUSDT", "price": 2.0}


def test_overlay_needs_a_snapshot_and_skips_nulls(spark):
    snap = bars_of(spark, [1])
    over = spark.createDataFrame([("s", "4h", T0, None, None, None, 9.0, None), ("x", "4h", T0, 1.0, 1.0, 1.0, 1.0, 1.0)], BAR)
    rows = serving.overlay(snap, over).collect()
    assert len(rows) == 1 and rows[0].close == 9.0 and rows[0].open == 1.0
    older = over.withColumn("ts", F.lit(T0 - datetime.timedelta(days=1)))
    assert serving.overlay(snap, older, newer_only=True).first().close == 1.0


def test_grid_has_every_cell(spark):
    rows = consensus(serving.latest(indicators(bars_of(spark, range(1, 41)), DEFAULT_SET)), PRESETS["DEFAULT"])
    out = {r.indicator: json.loads(r.row)[0] for r in serving.grid(rows, ["s"], None, [*DEFAULT_SET, "KNS", "other"]).collect()}
    assert len(out) == len(DEFAULT_SET) + 2 and out["other"]["text"] == "-" and out["SMA_200"]["colour"] == "grey" and out["RSI"]["colour"] == "blue"


def test_store_refuses_to_shrink_and_deletes(spark, tmp_path):
    own = store.SnapshotStore(spark, str(tmp_path / "snap"))
    rows = lambda n: bars_of(spark, range(1, n + 1)).withColumn("SMA", F.lit(1.0))
    assert own.write(rows(100)).first().write
    assert not own.write(rows(49)).first().write and own.read().count() == 100
    assert own.write(rows(50)).first().write and own.read(["s"], ["4h"]).count() == 50
    assert not own.write(bars_of(spark, range(80))).first().write
    assert json.loads(own.last_rows().first().row)["close"] == 50.0 and own.fresh().first().fresh and own.health().first()["rows"] == 50
    own.delete(F.col("symbol") == "s")
    assert own.read().count() == 0


def test_compaction_and_vacuum_keep_what_is_read(spark, tmp_path):
    own = store.SnapshotStore(spark, str(tmp_path / "snap"))
    rows = lambda n, symbol, **extra: bars_of(spark, range(1, n + 1), symbol=symbol).withColumns({"SMA": F.lit(1.0), **{k: F.lit(v) for k, v in extra.items()}})
    assert own.read().count() == 0 and own.compact() is None and own.vacuum() == []
    own.write(rows(20, "a", old=1))
    own.write(rows(30, "b"))
    own.write(rows(25, "a"))
    assert "old" not in own.read().columns
    before, updated = sorted(map(str, own.read().collect())), sorted(map(str, own.meta().select("symbol", "rows", "updated_at").collect()))
    reader = own.read()
    assert own.compact() and own.vacuum() == []
    assert len(before) == 55 == reader.count() and sorted(map(str, own.read().select(*reader.columns).collect())) == before
    assert sorted(map(str, own.meta().select("symbol", "rows", "updated_at").collect())) == updated
    assert len(own.vacuum(0)) == 3 and own.read().count() == 55 and own.vacuum(0) == []
    assert own.write(rows(40, "b")).first().write and own.read(["b"]).count() == 40 and own.read(["a"]).count() == 25


def test_forming_bars_take_ticks_patches_and_late_bars():
    import pandas as pd

    cols = ["kind", "ts", "open", "high", "low", "close", "volume", "seq"]
    n = float("nan")
    at = [pd.Timestamp(T0) + pd.Timedelta(hours=i) for i in range(6)]
    assert live.apply_events([], pd.DataFrame([["tick", pd.NaT, n, n, n, 5.0, n, 1]], columns=cols)) == []
    kept = live.apply_events([], pd.DataFrame([["bar", at[1], 2.0, 3.0, 1.0, 2.0, 5.0, 2], ["bar", at[0], 1.0, 1.0, 1.0, 1.0, 1.0, 3], ["tick", pd.NaT, n, n, n, 9.0, n, 4], ["patch", pd.NaT, n, n, n, 0.5, n, 5]], columns=cols))
    assert [b[0] for b in kept] == at[:2] and kept[-1][1:] == [2.0, 9.0, 1.0, 0.5, 5.0]
    kept = live.apply_events(kept, pd.DataFrame([["bar", at[i], 1.0, 1.0, 1.0, float(i), 1.0, i] for i in (5, 4, 3)], columns=cols))
    assert [b[0] for b in kept] == at[3:]


def test_throttle_and_ttl(spark):
    rows = QUERIES["stream_throttle_ttl"](spark, SF).collect()
    assert len(rows) == 4 and {r.expires_at for r in rows} == {datetime.datetime(2024, 1, 31, 0, 2)}


def test_every_query_without_sql_runs(spark):
    assert {*QUERIES} - {*ORACLES} <= {"user_selection_grid", "stream_throttle_ttl"}
    for name in ("user_selection_grid", "ind_default_set_filled"):
        assert QUERIES[name](spark, SF).count() > 0, name


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_straight_lines_over_checkpointed_blocks(spark):
    """Windows need neither exchange nor sort, no Python worker runs, and sums that build on each other don't double the plan."""
    for name, exchanges in (("ind_bollinger", 0), ("ind_rsi", 1), ("ind_adx_di", 2), ("ind_default_set_filled", 4)):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
        assert plan.count("Scan ExistingRDD") <= 1 + exchanges and "FileScan" not in plan, name
        assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= exchanges, name
    assert plan_of(QUERIES["ind_bollinger"](spark, SF)).count("Sort [") == 0
    plan = plan_of(QUERIES["bars_resample_4h"](spark, SF))
    assert "GreaterThan(value,0.0)" in plan and "user_id:" not in plan


@pytest.mark.parametrize(("span", "rows", "halo"), [(3, 64, 32), (14, 96, 48), (500, 60, 30), (500, 512, 512), (26, 7, 3)])
def test_averages_are_exact_whatever_the_span_and_the_blocks(spark, span, rows, halo):
    import pandas as pd

    rng = random.Random(span)
    closes = [100 + rng.gauss(0, 20) for _ in range(1500)]
    alpha = 2 / (span + 1)
    df = blocked(bars_of(spark, closes), rows=rows, halo=halo)
    out = recurrences(df, {"y": seeded(F.col("close"), 1, F.col("close"), alpha), "total": (F.col("close"), 1.0), "own": seeded(F.col("close"), 1, F.col("close"), F.lit(alpha))})
    wanted = pd.Series(closes).ewm(alpha=alpha, adjust=False).mean().tolist()
    halos = {r["_rn"]: r.y for r in out.where("_halo").collect()}
    got = finished(out).orderBy("ts").collect()
    assert [r.y for r in got] == pytest.approx(wanted, rel=1e-12) and [r.own for r in got] == pytest.approx(wanted, rel=1e-12)
    assert got[-1].total == pytest.approx(sum(closes)) and halos and all(wanted[n - 1] == pytest.approx(y, rel=1e-12) for n, y in halos.items())


@pytest.mark.parametrize(("few", "cells", "q"), [(3, 4, 0.7), (1, 2, 0.0), (5, 1024, 1.0), (10_000, 1024, 0.5)])
def test_exact_quantiles_of_ties_extremes_and_odd_rows(spark, few, cells, q):
    import numpy as np

    rng = random.Random(few)
    values = {"a": [rng.gauss(0, 1e6) for _ in range(200)], "b": [float(rng.randrange(4)) for _ in range(150)], "c": [7.0] * 90, None: [1.0, 2.0], "d": [-1e308, 1e308, 0.0], "e": [3.5]}
    rows = [(k, v) for k, vs in values.items() for v in [*vs, None, float("nan")]] + [("f", None)]
    got = {r.k: (r.n, r.quantile) for r in exact_quantile(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v", q, few, cells).collect()}
    assert got.keys() == values.keys() and all(got[k] == (len(vs), pytest.approx(float(np.quantile(vs, q)))) for k, vs in values.items() if k != "d")
    assert exact_quantile(spark.createDataFrame([], "k string, v double"), "k", "v", q).count() == 0


def test_messages_are_judged_and_none_is_lost(spark):
    texts = ['{"t":"bnc_kline","k":{"s":"x","c":"1"}}', '{"t":"mexc_deal","symbol":"y","price":2}', '{"t":"what"}', "[1]", "{", None, "", '{"t":"mexc_rest","symbol":"z","interval":"1m","poll":true,"data":{"time":[1]}}', '{"t":"mexc_deal","price":1}', "5"]
    rows = msg.judged_messages(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [r.reason for r in rows] == [None, None, "unknown kind", "no object", "not json", "not json", "not json", None, "no symbol", "no object"]
    assert [r.symbol for r in rows if r.reason is None] == ["x", "y", "z"] and rows[1].price == 2.0 and rows[7].poll and rows[7].payload.toPython() == {"time": [1]}


def test_trade_levels_follow_the_divergence(spark):
    rows = spark.createDataFrame([(100.0, 90.0, 4.0, 0.2, True), (100.0, 110.0, 4.0, 0.12, False), (100.0, 100.0, 0.0, 0.06, True)], "c double, s double, a double, g double, b boolean")
    got = [tuple(r.t) for r in rows.select(divergence.trade(F.col("c"), F.col("s"), F.col("a"), F.col("g"), F.col("b")).alias("t")).collect()]
    assert got == [(100.0, 88.0, 136.0, 12.0, 36.0, 3.0, 4.0), (100.0, 112.0, 70.0, 12.0, 30.0, 2.5, 4.0), (100.0, 100.0, 100.0, 0.0, 0.0, 0.0, 0.0)]
