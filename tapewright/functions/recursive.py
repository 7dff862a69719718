"""Recursive indicators: exponential and Wilder smoothing as recurrences over blocks of a series, exact over all of it.

An average y = y + alpha * (x - y) is the recurrence y = (1 - alpha) y + alpha x; a seed is the b of its own row, and
rows before it have b = 0. What builds on another average comes a pass later: each pass is one call of recurrences().
Rows of a missing price count as the price before; prices are never missing in bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.native import Stages, apply
from tapewright.operators.blocks import full, last, recurrences, series
from tapewright.plans.dims import WIDTHS, by_interval

RECURSIVE = {"RSI": ("RSI",), "ADX": ("ADX", "+DI", "-DI"), "+DI": ("ADX", "+DI", "-DI"), "-DI": ("ADX", "+DI", "-DI"), "EMA": ("EMA_3", "EMA_8", "EMA_Signal"), "MCD": ("MCD", "MCD_Signal", "MCD_Hist"), "SMI": ("SMI", "SMI_Signal"), "ADO": ("ADO",)}
RSI_ROWS, DI_ROWS, SMI_ROWS, SMI_SMOOTH, ADO_SPANS, EMA_SPANS = 14, 14, 14, 3, (3, 10), (3, 8)
MACD_DEFAULT = (24, 52, 18)
Steps = dict[str, tuple[Column, Column | float]]
RN = "_rn"


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, null where one of them is."""
    return F.when(b != 0, a / b).when(a.isNotNull() & b.isNotNull(), 0.0)


def span(n: int) -> float:
    return 2 / (n + 1)


def seeded(x: Column, at: Column | int, seed: Column, alpha: Column | float) -> tuple[Column, Column | float]:
    """The recurrence of an average of x with a seed in row `at`; 0 before."""
    row = F.col(RN)
    return F.when(row == at, seed).when(row > at, x * alpha), 1 - alpha


def mean_seeded(x: str, first: int, n: int, alpha: float) -> tuple[Column, Column | float]:
    """Seeded with the mean of the n values from row `first` on."""
    return seeded(F.col(x), first + n - 1, F.avg(x).over(last(n)), alpha)


def macd_part(k: int) -> Column:
    """The k-th MACD span of the row's width."""
    return F.coalesce(by_interval({name: w.macd[k] for name, w in WIDTHS.items()}), F.lit(MACD_DEFAULT[k]))


#: What a pass needs as columns, and its recurrences.
Pass = tuple[Stages, Steps]


# --- RSI ------------------------------------------------------------------------------------------------------------
def _rsi() -> Pass:
    sides = {"_up": F.greatest(F.col("_d"), F.lit(0.0)), "_down": F.greatest(-F.col("_d"), F.lit(0.0))}
    return [{"_d": F.col("close") - F.lag("close").over(series())}, sides], {f"_avg{k}": mean_seeded(k, 2, RSI_ROWS, 1 / RSI_ROWS) for k in sides}


def _rsi_done() -> Stages:
    return [{"RSI": full(100 * share(F.col("_avg_up"), F.col("_avg_up") + F.col("_avg_down")), RSI_ROWS + 1)}]


# --- ADX, +DI and -DI: Wilder sums begin with n - 1 rows; the first DI stands in row n + 1, the first ADX in row 2 n ------
def _directional() -> Pass:
    n = DI_ROWS
    before = F.lag("close").over(series())
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    first = {"_true": true, "_hi": F.col("high") - F.lag("high").over(series()), "_lo": F.lag("low").over(series()) - F.col("low")}
    moved = lambda a, b: F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0)
    wilder = lambda x: seeded(F.col(x), n, F.sum(x).over(last(n - 1)) / n, 1 / n)
    return [first, {"_plus": moved("_hi", "_lo"), "_minus": moved("_lo", "_hi")}], {f"_w{k}": wilder(k) for k in ("_true", "_plus", "_minus")}


def _adx() -> Pass:
    plus, minus = (full(100 * share(F.col(f"_w_{k}"), F.col("_w_true")), DI_ROWS + 1) for k in ("plus", "minus"))
    apart = 100 * share(F.abs(F.col("`+DI`") - F.col("`-DI`")), F.col("`+DI`") + F.col("`-DI`"))
    return [{"+DI": plus, "-DI": minus}, {"_dx": apart}], {"_w_dx": mean_seeded("_dx", DI_ROWS + 1, DI_ROWS, 1 / DI_ROWS)}


def _adx_done() -> Stages:
    return [{"ADX": full(F.col("_w_dx"), 2 * DI_ROWS)}]


# --- EMA ----------------------------------------------------------------------------------------------------------------
def _ema() -> Pass:
    return [], {f"_ema{n}": mean_seeded("close", 1, n, span(n)) for n in EMA_SPANS}


def _ema_done() -> Stages:
    fast, slow = EMA_SPANS
    return [{f"EMA_{n}": full(F.col(f"_ema{n}"), n) for n in EMA_SPANS}, {"EMA_Signal": 100 * share(F.col(f"EMA_{fast}") - F.col(f"EMA_{slow}"), F.col(f"EMA_{slow}"))}]


# --- MACD: averages from the first row on, given out once they have seen as many rows as their span ------------------------
def _macd() -> Pass:
    return [], {name: seeded(F.col("close"), 1, F.col("close"), 2 / (macd_part(k) + 1)) for k, name in enumerate(("_fast", "_slow"))}


def _macd_signal() -> Pass:
    line = F.when(F.col(RN) >= macd_part(1), F.col("_fast") - F.col("_slow"))
    return [{"MCD": line}], {"_sign": seeded(F.col("MCD"), macd_part(1), F.col("MCD"), 2 / (macd_part(2) + 1))}


def _macd_done() -> Stages:
    return [{"MCD_Signal": F.when(F.col(RN) >= macd_part(1) + macd_part(2) - 1, F.col("_sign"))}, {"MCD_Hist": F.col("MCD") - F.col("MCD_Signal")}]


# --- SMI: averages with finite weights, so each sum of weighted values is divided by the sum of its weights ---------------
_SMI_DECAY = 1 - span(SMI_SMOOTH)


def _weights(rows: Column) -> Column:
    return (1 - F.pow(F.lit(_SMI_DECAY), rows)) / (1 - _SMI_DECAY)


def _smi() -> Pass:
    top, bottom = F.max("high").over(last(SMI_ROWS)), F.min("low").over(last(SMI_ROWS))
    both = {"_mid": full(F.col("close") - (top + bottom) / 2, SMI_ROWS), "_spread": full(top - bottom, SMI_ROWS)}
    return [both], {f"{k}1": (F.col(k), _SMI_DECAY) for k in both}


def _smi_again() -> Pass:
    return [], {f"{k}2": (full(F.col(f"{k}1") / _weights(F.col(RN) - SMI_ROWS + 1), SMI_ROWS), _SMI_DECAY) for k in ("_mid", "_spread")}


def _smi_signal() -> Pass:
    value = 100 * share(full(F.col("_mid2"), SMI_ROWS), F.col("_spread2") / 2)  # the weights of both are the same
    return [{"SMI": F.coalesce(value, F.lit(0.0))}], {"_smi_sum": (F.col("SMI"), _SMI_DECAY)}


def _smi_done() -> Stages:
    return [{"SMI_Signal": F.col("_smi_sum") / _weights(F.col(RN))}]


# --- ADO: an average of a running sum, less that sum, is a recurrence of the sum's own steps -------------------------------
def _chaikin() -> Pass:
    flow = share((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")) * F.coalesce("volume", F.lit(0.0))
    return [], {f"_ado{n}": (F.when(F.col(RN) > 1, -(1 - span(n)) * flow), 1 - span(n)) for n in ADO_SPANS}


def _chaikin_done() -> Stages:
    fast, slow = ADO_SPANS
    return [{"ADO": F.when(F.col(RN) >= slow, F.col(f"_ado{fast}") - F.col(f"_ado{slow}")).otherwise(0.0)}]


#: For each family the passes that it needs one after the other, and what is made of them.
FAMILIES: dict[str, tuple[tuple[Callable[[], Pass], ...], Callable[[], Stages]]] = {
    "RSI": ((_rsi,), _rsi_done),
    "ADX": ((_directional, _adx), _adx_done),
    "EMA": ((_ema,), _ema_done),
    "MCD": ((_macd, _macd_signal), _macd_done),
    "SMI": ((_smi, _smi_again, _smi_signal), _smi_done),
    "ADO": ((_chaikin,), _chaikin_done),
}


def recursive_indicators(df: DataFrame, names: Iterable[str] = tuple(FAMILIES), sums: dict[str, str] | None = None, native: Iterable[Stages] = ()) -> DataFrame:
    """Blocked bars with the columns of the named recursive indicators, with running sums ({new column: column}), and with native stages.

    The k-th passes of all of them go together, the sums with the first ones, so there are three at most. What the sums
    need is in df or among the native stages, which come first.
    """
    families = list(dict.fromkeys("ADX" if n in ("+DI", "-DI") else n for n in names))
    passes = [[p() for p in FAMILIES[f][0]] for f in families]
    for k in range(max([len(p) for p in passes] + [1 if sums else 0])):
        own = [p[k] for p in passes if k < len(p)]
        df = apply(df, *(native if k == 0 else ()), *[stages for stages, _ in own])
        steps: Steps = {out: (F.col(f"`{c}`"), 1.0) for out, c in (sums or {}).items()} if k == 0 else {}
        df = recurrences(df, steps | {y: step for _, more in own for y, step in more.items()})
    return apply(df, *[FAMILIES[f][1]() for f in families])
