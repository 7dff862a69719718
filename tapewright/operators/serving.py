"""Serving: the newest row of each key, the live overlay over it, and the grid of classified cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.native import fib_nearest
from tapewright.operators.bars import tail
from tapewright.plans.dims import KEY


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each key, by a grouped maximum."""
    return tail(rows, 1)


def overlay(snapshot: DataFrame, live: DataFrame, newer_only: bool = False) -> DataFrame:
    """snapshot with the live row's values over it wherever they aren't null. Keys without a snapshot have no row.

    Only live columns that the snapshot has count. newer_only: a live row that is older than the snapshot has no effect.
    """
    names = [c for c in live.columns if c not in KEY and c in snapshot.columns]
    over = live.select(*KEY, *[F.col(f"`{c}`").alias(f"_{c}") for c in names])
    if newer_only and "ts" in names:
        joined = snapshot.join(over, list(KEY), "left")
        usable = F.coalesce(F.col("_ts") >= F.col("ts"), F.lit(False))
        pick = lambda c: F.coalesce(F.when(usable, F.col(f"`_{c}`")), F.col(f"`{c}`"))
    else:
        joined = snapshot.join(over, list(KEY), "left")
        pick = lambda c: F.coalesce(F.col(f"`_{c}`"), F.col(f"`{c}`"))
    return joined.select(*[pick(c).alias(c) if c in names else F.col(f"`{c}`") for c in snapshot.columns])


def shorten(value: Column) -> Column:
    return F.when(F.abs(value) >= 1_000_000, F.format_string("%.1fM", value / 1_000_000)).when(F.abs(value) >= 1_000, F.format_string("%.1fK", value / 1_000)).otherwise(F.format_string("%.2f", value))


def price_text(value: Column) -> Column:
    """A price with as many decimals as its size needs."""
    size = F.abs(value)
    return F.when(size >= 1000, F.format_string("%.1f", value)).when(size >= 1, F.format_string("%.2f", value)).when(size >= 0.01, F.format_string("%.4f", value)).otherwise(F.format_string("%.6f", value))


def _levels(value: Column, blue: float, green: float) -> Column:
    return F.when(value > blue, "blue").when(value > green, "green").otherwise("red")


def _sign(value: Column) -> Column:
    return F.when(value > 0, "green").otherwise("red")


def _cell(text: Column, colour: Column, flash: Column | None = None) -> Column:
    flash = F.lit(False) if flash is None else F.coalesce(flash, F.lit(False))
    return F.struct(F.coalesce(text, F.lit("-")).alias("text"), F.when(text.isNull(), "grey").otherwise(colour).alias("colour"), (flash & text.isNotNull()).alias("flash"))


def cell(name: str) -> Column:
    """struct(text, colour, flash) of an indicator in a row; "-" in grey for a missing value or an unknown name."""
    c = lambda n: F.col(f"`{n}`")
    two = lambda v: F.format_string("%.2f", v)
    text = lambda v, t: F.when(v.isNotNull(), t)
    # Limits of blue and green, and between which the cell flashes.
    scaled = {"CMF": (0.30, 0.0, -100, -42), "MFI": (80, 50, 1, 20), "SMI": (75, 0, -100, -40), "RSI": (75, 50, None, 35), "RSM": (75, 50, None, 35), "CCI": (200, 0, None, -100), "TRP": (50, 20, -50, -10)}
    if name in scaled:
        blue, green, low, high = scaled[name]
        v = c(name)
        flash = (v <= high if name == "CCI" else v < high) if low is None else v.between(low, high)
        return _cell(text(v, two(v)), _levels(v, blue, green), flash)
    if name == "WIL":
        v = c("WIL")
        return _cell(text(v, two(v)), _levels(v, -20, -80), v.between(-100, -90))
    if name in ("+DI", "-DI"):
        v = c("+DI") - c("-DI")
        return _cell(text(v, two(v)), F.when(v < 7, "red").otherwise("green"), v.between(-30, -15))
    if name in ("ADO", "OBV", "FRC"):
        return _cell(text(c(name), shorten(c(name))), _sign(c(name)))
    if name == "MCD":
        return _cell(text(c("MCD"), two(c("MCD"))), _sign(c("MCD")))
    if name == "VRT":
        v = c("VI+") - c("VI-")
        return _cell(text(v, two(v)), _sign(v))
    if name == "CVD":
        mom, slope = c("CVD_Mom"), F.coalesce("CVD_Slope", F.lit(0.0))
        arrow = F.when(slope > 0, "↑").when(slope < 0, "↓").otherwise("→")
        colour = F.when((mom > 0) & (slope > 0), "blue").when(mom > 0, "green").when((mom < 0) & (slope < 0), "red").otherwise("orange")
        return _cell(text(mom, F.concat(arrow, shorten(mom))), colour)
    if name == "VWAP":
        above = F.col("close") > c("VWAP")
        gap = 100 * F.try_divide(F.col("close") - c("VWAP"), F.nullif(c("VWAP"), F.lit(0.0)))
        return _cell(text(gap, F.concat(F.when(above, "↑").otherwise("↓"), price_text(c("VWAP")), F.format_string(" (%.2f%%)", gap))), F.when(above, "green").otherwise("red"))
    if name == "VOL":
        return _cell(text(c("Net_Volume"), shorten(c("Net_Volume"))), _sign(c("Net_Volume")), F.abs("Net_Volume_Z") >= 2)
    if name.startswith("SMA_"):
        return _cell(text(c(name), price_text(c(name))), F.when(F.col("close") > c(name), "green").otherwise("red"))
    if name == "ADX":
        return _cell(text(c("ADX"), two(c("ADX"))), F.when(c("ADX") >= 40, "green").otherwise("red"))
    if name == "STOCH":
        k, d = c("Stoch_K"), c("Stoch_D")
        return _cell(text(k, two(k)), F.when(k > d, "green").otherwise("red"))
    if name == "Fibonacci":
        near = fib_nearest(F.col("close"))
        arrow = F.when(F.col("close") >= near["level"], "↑").otherwise("↓")
        return _cell(text(near, F.concat(arrow, near["name"], F.lit(" "), price_text(near["level"]))), F.when(F.col("close") >= near["level"], "green").otherwise("red"))
    if name == "EMA":
        v = c("EMA_Signal")
        return _cell(text(v, two(v)), _sign(v), v < -1)
    if name == "BOL":
        up = F.col("close") > c("BB_Middle")
        return _cell(text(c("BB_Middle"), F.when(up, "↑").otherwise("↓")), F.when(up, "green").otherwise("red"))
    if name == "TRD":
        signal, strong = c("COMBINED_TREND_SIGNAL"), c("TRD_ADX") >= 40
        return _cell(F.when(signal.isin("BUY", "SELL", "WAIT"), F.format_string("A%.0f D%.0f R%.0f", "TRD_ADX", c("TRD_PLUS_DI") - c("TRD_MINUS_DI"), c("TRD_RSI"))), F.when(signal == "BUY", F.when(strong, "blue").otherwise("green")).otherwise("red"), (signal == "SELL") & strong)
    if name == "SR":
        v = c("SR_SIGNAL")
        return _cell(text(v, F.concat(price_text(c("SR_SUPPORT")), F.lit("/"), price_text(c("SR_RESISTANCE")))), F.when(v == "support", "blue").when(v == "near_support", "green").when(v == "neutral", "grey").when(v == "resistance", "red").otherwise("orange"))
    if name == "KNS":
        v = c("kns_signal")
        icon = F.when(v == "STRONG_BUY", "⬆⬆").when(v == "BUY", "⬆").when(v == "STRONG_SELL", "⬇⬇").when(v == "SELL", "⬇").otherwise("➖")
        return _cell(F.when(v != "NO_DATA", F.concat(icon, F.format_string(" %d/%d/%d", "kns_buy", "kns_sell", "kns_neutral"))), F.when(v.endswith("BUY"), "green").when(v.endswith("SELL"), "red").otherwise("grey"), v.startswith("STRONG"))
    if name in ("DIV", "DIVERGENCE"):
        v = c(name)
        return _cell(v, F.when(v.contains("🔴"), "red").when(v.contains("🟢"), "green").otherwise("grey"))
    if name.startswith("TPD"):
        return _tpd_cell(name, c)
    return F.struct(F.lit("-").alias("text"), F.lit("grey").alias("colour"), F.lit(False).alias("flash"))


def _tpd_cell(name: str, c) -> Column:
    v = c(name)
    if name in ("TPD_Signal", "TPD_Raw_Signal"):
        return _cell(v, F.when(v.contains("BUY"), "green").when(v.contains("SELL"), "red").otherwise("grey"), v.startswith("STRONG"))
    if name in ("TPD_Reliability", "TPD_MTF_Confluence", "TPD_Strength"):
        low, high = (0.6, 0.8) if name == "TPD_Reliability" else (0.5, 0.8)
        return _cell(F.when(v.isNotNull(), F.format_string("%.2f", v)), F.when(v >= high, "blue").when(v >= low, "green").otherwise("red"))
    if name in ("TPD_Trend", "TPD_Risk", "TPD_Divergence"):
        return _cell(v, F.when(v.isin("UPTREND", "LOW", "BULLISH_DIVERGENCE"), "green").when(v.isin("DOWNTREND", "HIGH", "BEARISH_DIVERGENCE"), "red").otherwise("grey"))
    return _cell(F.when(v.isNotNull(), F.format_string("%.2f", v)), _levels(v, 1, 0) if name == "TPD_Momentum" else _sign(v))


def cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """key, indicator, text, colour, flash: one row for each key and indicator (an unpivot of structs, no join)."""
    each = F.array(*[F.struct(F.lit(n).alias("indicator"), cell(n).alias("cell")) for n in names])
    return rows.select(*KEY, F.explode(each).alias("e")).select(*KEY, "e.indicator", "e.cell.*")


def grid(rows: DataFrame, symbols: list[str] | None, intervals: list[str] | None, names: list[str]) -> DataFrame:
    """symbol, indicator, row: the JSON of the chosen cells by interval. Null choices mean all."""
    chosen = rows
    if symbols is not None:
        chosen = chosen.where(F.col("symbol").isin(*symbols))
    if intervals is not None:
        chosen = chosen.where(F.col("interval").isin(*intervals))
    packed = F.sort_array(F.collect_list(F.struct("interval", "text", "colour", "flash")))
    return cells(chosen, names).groupBy("symbol", "indicator").agg(F.to_json(packed).alias("row"))
