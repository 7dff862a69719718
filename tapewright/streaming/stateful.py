"""Keyed state with several parts and timers: incremental indicators, and live rows that expire by themselves.

Both keep what a key needs in RocksDB and go on from the checkpoint after a restart. Start them by live.serve.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.functions.stepwise import OUTPUTS, Series
from tapewright.plans.dims import KEY, WIDTHS
from tapewright.streaming.live import gathered

INCREMENTAL = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double, seq long, late long, " + ", ".join(f"`{c}` double" for c in OUTPUTS)
EXPIRING = "symbol string, interval string, at timestamp, price double, expires_at timestamp, status string"


def micros(t: pd.Timestamp) -> int:
    return t.value // 1000


class Incremental(StatefulProcessor):
    """State of a key: the series after its closed bars, and its forming bar.

    The closed part is written when a bar closes; events of the forming bar only rewrite that bar, and its indicators
    are a step from a copy of the closed part. So a forming bar's share is never in what is kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "series string, late long")
        self.forming = handle.getValueState("forming", "ts long, open double, high double, low double, close double, volume double, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text, late = self.closed.get() if self.closed.exists() else (None, 0)
        series, moved = Series(key[1], json.loads(text) if text else None), False
        now = list(self.forming.get()) if self.forming.exists() else None
        for e in gathered(rows).sort_values(["seq", "ts"], kind="stable").itertuples(index=False):
            if e.kind == "bar":
                at = micros(e.ts)
                if now is not None and (at < now[0] or (at == now[0] and e.seq < now[6])):
                    late, moved = late + (at < now[0]), True
                    continue
                if now is not None and at > now[0]:
                    series.step(*now[:6])
                    moved = True
                now = [at, e.open, e.high, e.low, e.close, e.volume, e.seq]
            elif now is not None and e.seq >= now[6]:
                now[4], now[6] = e.close, e.seq
                if e.kind == "tick":
                    now[2], now[3] = max(now[2], e.close), min(now[3], e.close)
        if now is None:
            return
        now = [int(now[0]), *map(float, now[1:6]), int(now[6])]
        if moved:
            self.closed.update((json.dumps(series.state), int(late)))
        self.forming.update(tuple(now))
        values = series.copy().step(*now[:6])
        yield pd.DataFrame([[*key, pd.Timestamp(now[0], unit="us"), *now[1:6], now[6], int(late), *[values.get(c) for c in OUTPUTS]]], columns=[*KEY, "ts", "open", "high", "low", "close", "volume", "seq", "late", *OUTPUTS]).astype(dict.fromkeys(OUTPUTS, "float64"))


def incremental_indicators(events: DataFrame) -> DataFrame:
    """A stream of each touched key's forming bar with its indicators, from a stream of events (live.EVENT): OUTPUTS over the key's whole history.

    Bars come in the order of ts; an older one than the forming bar is left out and counted in `late`. Ticks and patches
    move the forming bar.
    """
    return events.groupBy(*KEY).transformWithStateInPandas(Incremental(), INCREMENTAL, "Update", "None")


class Expiring(StatefulProcessor):
    """State of a key: its live row and when that expires; a timer stands at that time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "at long, price double, expires long")

    def _row(self, key, at: int, price: float, expires: int, status: str) -> list:
        return [*key, pd.Timestamp(at, unit="us"), price, pd.Timestamp(expires, unit="us"), status]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ttl = (WIDTHS[key[1]].live_ttl_s if key[1] in WIDTHS else 30) * 1_000_000
        now = self.live.get() if self.live.exists() else None
        if now is not None:
            self.handle.deleteTimer(int(now[2]) // 1000 + 1)
        out = []
        for e in gathered(rows).sort_values("at", kind="stable").itertuples(index=False):
            at = micros(e.at)
            if now is not None and at < now[0]:
                continue  # older than the live row
            if now is not None and at >= now[2]:
                out.append(self._row(key, *map(int, now[:1]), now[1], int(now[2]), "expired"))
            now = (at, float(e.price), at + ttl)
        self.live.update((int(now[0]), float(now[1]), int(now[2])))
        self.handle.registerTimer(int(now[2]) // 1000 + 1)
        out.append(self._row(key, int(now[0]), now[1], int(now[2]), "live"))
        yield pd.DataFrame(out, columns=[*KEY, "at", "price", "expires_at", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.live.exists():
            at, price, expires = self.live.get()
            self.live.clear()
            yield pd.DataFrame([self._row(key, int(at), float(price), int(expires), "expired")], columns=[*KEY, "at", "price", "expires_at", "status"])


def expiring_rows(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of live rows (key, at, price) with their end: each touched key's newest row as "live", and every row as "expired" that no newer one of its key came for within its width's time to live.

    Expiry goes by event time: a newer row tells it, or the watermark by a timer, so keys that fall silent expire too.
    """
    return rows.withWatermark("at", late).groupBy(*KEY).transformWithStateInPandas(Expiring(), EXPIRING, "Update", "EventTime")
