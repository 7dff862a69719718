"""The small fixed tables of the market engine: bar widths and their parameters, indicator sets, vote weights, presets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("symbol", "interval")
BAR = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"


class Width(NamedTuple):
    seconds: int
    window: int  # rows of the live and composite window
    throttle_s: float
    live_ttl_s: int
    heavy_throttle_s: int
    refresh_s: int
    volume_period: int
    macd: tuple[int, int, int]


# Parameters of each bar width.
WIDTHS: dict[str, Width] = {
    "1m": Width(60, 120, 0.4, 10, 1, 5, 10, (6, 13, 4)),
    "3m": Width(180, 120, 0.5, 12, 2, 8, 10, (6, 13, 4)),
    "5m": Width(300, 120, 0.7, 15, 3, 12, 12, (6, 13, 4)),
    "15m": Width(900, 150, 1.0, 30, 5, 25, 8, (12, 26, 9)),
    "30m": Width(1800, 150, 1.5, 45, 8, 40, 8, (12, 26, 9)),
    "1h": Width(3600, 150, 2.0, 60, 12, 60, 12, (12, 26, 9)),
    "2h": Width(7200, 200, 3.0, 90, 20, 90, 12, (24, 52, 18)),
    "4h": Width(14400, 200, 5.0, 120, 30, 120, 12, (24, 52, 18)),
    "6h": Width(21600, 200, 8.0, 180, 45, 180, 12, (24, 52, 18)),
    "8h": Width(28800, 200, 8.0, 180, 45, 180, 12, (24, 52, 18)),
    "12h": Width(43200, 250, 12.0, 240, 60, 240, 14, (24, 52, 18)),
    "1d": Width(86400, 300, 20.0, 300, 90, 300, 30, (24, 52, 18)),
    "3d": Width(259200, 300, 30.0, 300, 120, 300, 30, (24, 52, 18)),
}
# Widths that are built from another one, as (source width, how many).
DERIVED = {"3m": ("1m", 3), "2h": ("1h", 2), "6h": ("1h", 6), "12h": ("1h", 12), "3d": ("1d", 3)}
SNAPSHOT_TTL_S, STALE_S = 3600, 8
LIVE_POLL_LIMIT, HISTORY = 100, 500

# The indicators that are always computed.
DEFAULT_SET = ("RSI", "RSM", "MFI", "SMI", "CMF", "ADO", "+DI", "ADX", "CCI", "WIL", "SR", "VOL", "CVD", "VWAP", "EMA", "MCD", "SMA_20", "SMA_50", "SMA_200", "BOL", "OBV", "VRT", "FRC", "TRP", "TRD")
# What the live path leaves out.
HEAVY_SET = ("SR", "Fibonacci", "TRD", "DIV", "DIVERGENCE")
# Vote weights; any other indicator weighs 1.
WEIGHTS = {
    "RSI": 1.5, "MFI": 1.5, "RSM": 1.0, "SMI": 1.5, "WIL": 1.0, "CCI": 1.0, "CMF": 1.5, "ADO": 1.0, "TRP": 1.0, "FRC": 0.8, "CVD": 1.8, "VOL": 2.0, "VWAP": 1.5,
    "SMA_20": 0.5, "SMA_50": 0.5, "SMA_200": 0.5, "TRD": 2.0, "ADX": 1.0, "MCD": 1.5, "EMA": 1.0, "BOL": 1.0, "VRT": 0.8, "OBV": 0.8,
}
# Indicators that never vote.
VOTELESS = ("DIV", "DIVERGENCE", "Fibonacci")
# Preset combinations for the consensus.
PRESETS: dict[str, tuple[str, ...]] = {
    "DEFAULT": ("VOL", "CVD", "VWAP"),
    "MOMENTUM": ("RSI", "MFI", "SMI", "CCI", "WIL"),
    "VOLUME": ("VOL", "CVD", "OBV", "CMF", "ADO"),
    "TREND": ("TRD", "ADX", "+DI", "EMA", "MCD"),
}
# Names of widths at the second exchange.
EXCHANGE_WIDTHS = {"1m": "Min1", "3m": "Min3", "5m": "Min5", "15m": "Min15", "30m": "Min30", "1h": "Min60", "4h": "Hour4", "8h": "Hour8", "1d": "Day1"}


def by_interval(values: dict, interval: str = "interval") -> Column:
    """A look-up of a number by the interval column; null for an unknown width."""
    kind = "double" if any(isinstance(v, float) for v in values.values()) else "int"
    return F.expr(f"CASE `{interval}` " + " ".join(f"WHEN '{name}' THEN CAST({value} AS {kind})" for name, value in values.items()) + " END")


def seconds(interval: str = "interval") -> Column:
    return by_interval({k: w.seconds for k, w in WIDTHS.items()}, interval)


def interval_table(spark: SparkSession) -> DataFrame:
    """interval and its parameters, one row for each width."""
    rows = [(k, w.seconds, w.window, w.throttle_s, w.live_ttl_s, w.heavy_throttle_s, w.refresh_s, w.volume_period, *w.macd) for k, w in WIDTHS.items()]
    return spark.createDataFrame(rows, "interval string, seconds long, window int, throttle_s double, live_ttl_s int, heavy_throttle_s int, refresh_s int, volume_period int, macd_fast int, macd_slow int, macd_sign int")


def derived_table(spark: SparkSession) -> DataFrame:
    rows = [(k, s, n) for k, (s, n) in DERIVED.items()]
    return spark.createDataFrame(rows, "interval string, source string, factor int")


def matching_preset(chosen: list[str]) -> str:
    """The preset with just these indicators, in any order; DEFAULT if there is none."""
    return next((name for name, members in PRESETS.items() if set(members) == set(chosen)), "DEFAULT")
