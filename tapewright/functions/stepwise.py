"""The indicators bar by bar: what a series has seen so far is a few numbers, and short windows of values.

Smoothing averages and running sums are one number each, so their whole history counts without being kept; an indicator
over a window keeps the values of its window. The definitions are those of the batch (native.py, recursive.py).
"""

from __future__ import annotations

from datetime import UTC, datetime
from statistics import fmean, stdev

from tapewright.functions.recursive import ADO_SPANS, DI_ROWS, EMA_SPANS, MACD_DEFAULT, RSI_ROWS, SMI_ROWS, SMI_SMOOTH, span
from tapewright.plans.dims import WIDTHS

OUTPUTS = (
    *("RSI", "ADX", "+DI", "-DI", "EMA_3", "EMA_8", "EMA_Signal", "MCD", "MCD_Signal", "MCD_Hist", "SMI", "SMI_Signal", "ADO", "OBV", "CVD_Delta", "CVD", "CVD_Mom", "CVD_Slope", "VWAP"),
    *("SMA_20", "SMA_50", "SMA_200", "BB_Upper", "BB_Middle", "BB_Lower", "RSM", "TRP", "MFI", "CMF", "CCI", "WIL", "Stoch_K", "Stoch_D", "Net_Volume_Raw", "Net_Volume", "Net_Volume_Z", "VI+", "VI-", "FRC"),
)
SEED_ROWS = 2 * DI_ROWS


def over(a: float | None, b: float | None) -> float | None:
    """a / b, None for a zero or missing denominator."""
    return None if a is None or not b else a / b


def share(a: float, b: float) -> float:
    return a / b if b else 0.0


class Series:
    """A series after some bars. `state` is all that it needs to go on: numbers and lists of numbers by name, fit for JSON."""

    def __init__(self, interval: str, state: dict | None = None):
        self.interval, self.state = interval, state or {"n": 0}

    def copy(self) -> Series:
        return Series(self.interval, {k: list(v) if isinstance(v, list) else v for k, v in self.state.items()})

    def _push(self, name: str, value, size: int) -> list:
        window = self.state.setdefault(name, [])
        window.append(value)
        del window[:-size]
        return window

    def _average(self, name: str, x: float, at: int, seed: float | None, alpha: float) -> None:
        """The average is the seed in row `at` and moves on from there."""
        s = self.state
        if s["n"] == at:
            s[name] = seed
        elif s["n"] > at:
            s[name] = (1 - alpha) * s[name] + alpha * x

    def _sum(self, name: str, x: float, decay: float = 1.0) -> float:
        self.state[name] = decay * self.state.get(name, 0.0) + x
        return self.state[name]

    def step(self, micros: int, o: float, h: float, low: float, c: float, v: float) -> dict[str, float | None]:
        """Takes a bar in and gives its indicators; None where the batch has null."""
        s = self.state
        n = s["n"] = s["n"] + 1
        before = s.get("bar")
        s["bar"] = [h, low, c]
        out = self._trend(n, h, low, c, before) | self._smooth(n, h, low, c, v) | self._volume(n, micros, o, h, low, c, v, before) | self._windows(n, h, low, c, v, before)
        if n == SEED_ROWS:  # windows that only averages' seeds need
            for name in ("_true", "_plus", "_minus", "_dx"):
                s.pop(name, None)
        return out

    def _trend(self, n: int, h: float, low: float, c: float, before: list | None) -> dict:
        s = self.state
        step = c - before[2] if before else 0.0
        changes = self._push("changes", step, RSI_ROWS)
        for name, side in (("up", 1), ("down", -1)):
            self._average(name, max(side * step, 0.0), RSI_ROWS + 1, fmean(max(side * x, 0.0) for x in changes), 1 / RSI_ROWS)
        up, down = (h - before[0], before[1] - low) if before else (0.0, 0.0)
        parts = {
            "_true": max(h - low, abs(h - before[2]), abs(low - before[2])) if before else h - low,
            "_plus": up if up > down and up > 0 else 0.0,
            "_minus": down if down > up and down > 0 else 0.0,
        }
        for name, x in parts.items():
            seed = sum(self._push(name, x, DI_ROWS - 1)) / DI_ROWS if n <= DI_ROWS else None
            self._average("w" + name, x, DI_ROWS, seed, 1 / DI_ROWS)
        plus = minus = None
        if n > DI_ROWS:
            plus, minus = (100 * share(s[k], s["w_true"]) for k in ("w_plus", "w_minus"))
            dx = 100 * share(abs(plus - minus), plus + minus)
            self._average("w_dx", dx, SEED_ROWS, fmean(self._push("_dx", dx, DI_ROWS)) if n <= SEED_ROWS else None, 1 / DI_ROWS)
        gains, losses = [max(x, 0.0) for x in changes], [max(-x, 0.0) for x in changes]
        short = sum(gains[-13:]) + sum(losses[-13:])
        return {
            "RSI": 100 * share(s["up"], s["up"] + s["down"]) if n > RSI_ROWS else None,
            "ADX": s["w_dx"] if n >= SEED_ROWS else None,
            "+DI": plus,
            "-DI": minus,
            "RSM": 100 - 100 / (1 + fmean(gains) / (fmean(losses) or 1.0)) if n >= 14 else 0.0,
            "TRP": 100 * (sum(gains[-13:]) - sum(losses[-13:])) / short if n >= 13 and short else 0.0,
        }

    def _smooth(self, n: int, h: float, low: float, c: float, v: float) -> dict:
        s = self.state
        closes = self._push("closes", c, 200)
        for k in EMA_SPANS:
            self._average(f"ema{k}", c, k, fmean(closes[-k:]), span(k))
        fast, slow = (s[f"ema{k}"] if n >= k else None for k in EMA_SPANS)
        width = WIDTHS.get(self.interval)
        spans = width.macd if width else MACD_DEFAULT
        for name, k in (("fast", spans[0]), ("slow", spans[1])):
            self._average(name, c, 1, c, span(k))
        line = s["fast"] - s["slow"] if n >= spans[1] else None
        if line is not None:
            self._average("sign", line, spans[1], line, span(spans[2]))
        sign = s["sign"] if n >= spans[1] + spans[2] - 1 else None
        highs, lows = self._push("highs", h, SMI_ROWS), self._push("lows", low, SMI_ROWS)
        decay = 1 - span(SMI_SMOOTH)
        weights = lambda rows: (1 - decay**rows) / (1 - decay)
        value = 0.0
        if n >= SMI_ROWS:
            top, bottom, own = max(highs), min(lows), weights(n - SMI_ROWS + 1)
            mid = self._sum("mid2", self._sum("mid1", c - (top + bottom) / 2, decay) / own, decay)
            spread = self._sum("spread2", self._sum("spread1", top - bottom, decay) / own, decay)
            value = 100 * share(mid, spread / 2)
        flow = share((c - low) - (h - c), h - low) * v
        averages = [self._sum(f"ado{k}", -(1 - span(k)) * flow if n > 1 else 0.0, 1 - span(k)) for k in ADO_SPANS]
        return {
            **{f"EMA_{k}": x for k, x in zip(EMA_SPANS, (fast, slow), strict=True)},
            "EMA_Signal": 100 * share(fast - slow, slow) if slow is not None else None,
            "MCD": line,
            "MCD_Signal": sign,
            "MCD_Hist": line - sign if sign is not None else None,
            "SMI": value,
            "SMI_Signal": self._sum("smi", value, decay) / weights(n),
            "ADO": averages[0] - averages[1] if n >= ADO_SPANS[1] else 0.0,
        }

    def _volume(self, n: int, micros: int, o: float, h: float, low: float, c: float, v: float, before: list | None) -> dict:
        s = self.state
        delta = v if c > o else -v if c < o else 0.0
        deltas = self._push("deltas", delta, 20)
        day = datetime.fromtimestamp(micros / 1e6, UTC).toordinal()
        if s.get("day") != day:
            s["day"], s["tpv"], s["vol"] = day, 0.0, 0.0
        raw = 0.0 if before is None or c == before[2] else v if c > before[2] else -v
        width = WIDTHS.get(self.interval)
        net = sum(self._push("raws", raw, max(30, width.volume_period if width else 30))[-(width.volume_period if width else 30) :])
        nets = self._push("nets", net, 100)
        z = 0.0
        if n >= 5 and (spread := stdev(nets)) > 1e-9:
            z = (net - fmean(nets)) / spread
        return {
            "OBV": self._sum("obv", v if before is None or c >= before[2] else -v),
            "CVD_Delta": delta,
            "CVD": self._sum("cvd", delta),
            "CVD_Mom": sum(deltas),
            "CVD_Slope": sum(deltas[-5:]) if n >= 6 else None,
            "VWAP": over(self._sum("tpv", (h + low + c) / 3 * v), self._sum("vol", v)),
            "Net_Volume_Raw": raw,
            "Net_Volume": net,
            "Net_Volume_Z": z if n >= 5 else None,
            "FRC": (c - before[2]) * v if before else None,
        }

    def _windows(self, n: int, h: float, low: float, c: float, v: float, before: list | None) -> dict:
        s = self.state
        closes, highs, lows = s["closes"], s["highs"], s["lows"]
        typical = (h + low + c) / 3
        old = s.get("typicals", [None])[-1]
        typicals = self._push("typicals", typical, 9)
        ins = self._push("ins", typical * v if old is not None and typical > old else 0.0, 14)
        outs = self._push("outs", typical * v if old is not None and typical < old else 0.0, 14)
        money = self._push("money", share((c - low) - (h - c), h - low) * v, 20)
        volumes = self._push("volumes", v, 20)
        true = self._push("trues", max(h - low, abs(h - before[2]), abs(low - before[2])) if before else h - low, 14)
        plus = self._push("vps", abs(h - before[1]) if before else 0.0, 14)
        minus = self._push("vms", abs(low - before[0]) if before else 0.0, 14)
        top, bottom = max(highs), min(lows)
        flows = sum(ins) + sum(outs)
        mean9 = fmean(typicals)
        deviation = sum(abs(x - mean9) for x in typicals) / 9
        quick = over(100 * (c - bottom), top - bottom) if n >= 14 else None
        known = [x for x in self._push("quicks", quick, 3) if x is not None]
        out = {f"SMA_{k}": fmean(closes[-k:]) if n >= k else None for k in (20, 50, 200)}
        if n >= 20:
            mean, spread = fmean(closes[-20:]), stdev(closes[-20:])
            out |= {"BB_Upper": mean + 2 * spread, "BB_Middle": mean, "BB_Lower": mean - 2 * spread}
        return out | {
            "MFI": (0.0 if flows < 1 else 100 * sum(ins) / flows) if n >= 15 else None,
            "CMF": over(sum(money), sum(volumes)) if n >= 20 else None,
            "CCI": (0.0 if deviation < 1e-12 else (typical - mean9) / (0.015 * deviation)) if n >= 9 else None,
            "WIL": (over(100 * (c - top), top - bottom) or 0.0) if n >= 14 else None,
            "Stoch_K": quick,
            "Stoch_D": fmean(known) if n >= 16 and known else None,
            "VI+": over(sum(plus), sum(true)) if n >= 15 else None,
            "VI-": over(sum(minus), sum(true)) if n >= 15 else None,
        }
