"""Decoding of raw market messages: a tagged union in JSON, one message in a row, to bars, ticks and price patches.

A message is {"t": kind, "symbol", "interval", "price", "poll", "k" | "kd" | "data"}. Every decoder is a filter and a
projection, so the same code serves batch and streams. Times of less than 1e12 are seconds, others milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.bars import PRICES
from tapewright.plans.dims import EXCHANGE_WIDTHS

BAR_COLUMNS = ("symbol", "interval", "ts", *PRICES, "volume")
# Kinds of messages.
KINDS = ("bnc_kline", "mexc_deal", "mexc_kline", "bnc_rest", "mexc_rest", "price_rest")
_ENVELOPE = "t string, symbol string, interval string, price double, poll boolean, k string, kd string, data string"
_KLINE = "s string, i string, t long, o string, h string, l string, c string, v string"
_PUSHED = "t long, o double, h double, l double, c double, v double, vol double"
_ARRAYS = "time array<long>, open array<double>, high array<double>, low array<double>, close array<double>, vol array<double>, volume array<double>"


def moment(epoch: Column) -> Column:
    """A TIMESTAMP of epoch seconds or milliseconds."""
    return F.timestamp_millis(F.when(epoch < 1_000_000_000_000, epoch * 1000).otherwise(epoch))


def messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """The envelope's fields of a column of JSON texts. What isn't a message of a known kind is left out."""
    return raw.select(F.from_json(F.col(column).cast("string"), _ENVELOPE).alias("m")).select("m.*").where(F.col("t").isin(*KINDS))


def judged_messages(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every text of a column with its envelope's fields, its payload as VARIANT, the reason why it is no message (null for one), and the columns `keep`.

    The payload is k, kd or data, whichever is there, as it came: numbers, texts, arrays or objects. Reasons: not json, no
    object, unknown kind, no symbol. Nothing is left out, so that what is rejected can be counted and kept aside.
    """
    text = F.col(column).cast("string")
    rows = raw.select(text.alias("raw"), F.try_parse_json(text).alias("v"), *keep)
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    payload = F.coalesce(*[F.try_variant_get("v", f"$.{name}", "variant") for name in ("k", "kd", "data")])
    rows = rows.select(*keep, "raw", "v", field("t", "string").alias("t"), field("symbol", "string").alias("symbol"), field("interval", "string").alias("interval"), field("price", "double").alias("price"), field("poll", "boolean").alias("poll"), payload.alias("payload"))
    symbol = F.coalesce("symbol", F.try_variant_get("payload", "$.s", "string"))
    reason = (
        F.when(F.col("v").isNull(), "not json")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "no object")
        .when(~F.coalesce(F.col("t").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(symbol.isNull(), "no symbol")
    )
    return rows.withColumns({"symbol": symbol, "reason": reason}).drop("v")


def pushed_frames(raw: DataFrame, column: str = "value") -> DataFrame:
    """Messages from raw feed frames {"stream", "data": {"e": "kline", "k": {...}}} or the inner object alone: only kline events."""
    inner = F.coalesce(F.get_json_object(column, "$.data"), F.col(column))
    return raw.select(inner.alias("d")).where(F.get_json_object("d", "$.e") == "kline").select(F.lit("bnc_kline").alias("t"), F.get_json_object("d", "$.k").alias("k"))


def deal_frames(raw: DataFrame, column: str = "value") -> DataFrame:
    """Ticks from frames {"channel": "push.deal", "symbol", "data": [{"p" | "price"}]}: the last deal of a frame, if its price is above 0."""
    parsed = raw.select(F.from_json(F.col(column), "channel string, symbol string, data array<struct<p:double,price:double>>").alias("f")).select("f.*")
    last = F.try_element_at("data", F.lit(-1))
    price = F.coalesce(last["p"], last["price"])
    return parsed.where(F.col("channel") == "push.deal").select(plain_symbol(F.col("symbol")).alias("symbol"), price.alias("price")).where(F.col("price") > 0)


def klines(messages: DataFrame) -> DataFrame:
    """Bars of kline events; the numbers are texts."""
    k = messages.where(F.col("t") == "bnc_kline").select(F.from_json("k", _KLINE).alias("k")).select("k.*")
    number = lambda c: F.col(c).try_cast("double")
    return k.select(F.col("s").alias("symbol"), F.col("i").alias("interval"), moment(F.col("t")).alias("ts"), *[number(c).alias(n) for c, n in zip("ohlcv", (*PRICES, "volume"), strict=True)]).dropna(subset=["symbol", "interval", "ts", "close"])


def pushed_klines(messages: DataFrame) -> DataFrame:
    """Bars of the second exchange's klines: the close is needed, other prices default to it, the volume to 0."""
    rows = messages.where(F.col("t") == "mexc_kline").select("symbol", "interval", F.from_json("kd", _PUSHED).alias("k")).select("symbol", "interval", "k.*").where(F.col("c") != 0)
    price = lambda c: F.coalesce(c, "c")
    return rows.select("symbol", "interval", moment(F.col("t")).alias("ts"), price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), F.col("c").alias("close"), F.coalesce("v", "vol", F.lit(0.0)).alias("volume"))


def array_rows(messages: DataFrame) -> DataFrame:
    """Bars of snapshots that are arrays of rows, of which the first six fields count."""
    rows = messages.where(F.col("t") == "bnc_rest").select("symbol", "interval", F.explode(F.from_json("data", "array<array<string>>")).alias("r"))
    field = lambda i: F.get("r", i).try_cast("double")
    return rows.select("symbol", "interval", moment(F.get("r", 0).try_cast("bigint")).alias("ts"), *[field(i + 1).alias(n) for i, n in enumerate((*PRICES, "volume"))]).dropna(subset=["ts", "open", "close"])


def struct_of_arrays(messages: DataFrame) -> DataFrame:
    """Bars of snapshots that are one array for each field; poll marks those that only add to what is known."""
    rows = messages.where(F.col("t") == "mexc_rest").select("symbol", "interval", F.coalesce("poll", F.lit(False)).alias("poll"), F.from_json("data", _ARRAYS).alias("d")).select("symbol", "interval", "poll", "d.*")
    zipped = rows.withColumn("v", F.coalesce("vol", "volume")).select("symbol", "interval", "poll", F.explode(F.arrays_zip("time", "open", "high", "low", "close", "v")).alias("z"))
    bars = zipped.select("symbol", "interval", moment(F.col("z.time")).alias("ts"), *[F.col(f"z.{c}").alias(c) for c in PRICES], F.col("z.v").alias("volume"), "poll")
    return bars.dropna(subset=["ts", "open", "close"])


def deals(messages: DataFrame) -> DataFrame:
    """symbol, price of ticks above 0."""
    return messages.where((F.col("t") == "mexc_deal") & (F.col("price") > 0)).select("symbol", "price")


def price_patches(messages: DataFrame) -> DataFrame:
    """symbol, interval, price: new closes of forming bars."""
    return messages.where((F.col("t") == "price_rest") & (F.col("price") > 0)).select("symbol", "interval", "price")


def bars_of(messages: DataFrame) -> DataFrame:
    """All bars in the messages, in one form."""
    parts = [f(messages).select(*BAR_COLUMNS) for f in (klines, pushed_klines, array_rows, struct_of_arrays)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def wanted(bars: DataFrame, symbols: DataFrame, intervals: list[str]) -> DataFrame:
    """Bars of active symbols (column symbol) and of the intervals only."""
    return bars.where(F.col("interval").isin(*intervals)).join(symbols.select("symbol"), "symbol", "left_semi")


def plain_symbol(symbol: Column, suffix: str = "USDT") -> Column:
    """A symbol in capitals without separators, ending with the quote currency."""
    bare = F.upper(F.regexp_replace(F.trim(symbol), r"[_\-/\s]", ""))
    return F.when(bare == "", F.lit(None)).when(F.endswith(bare, F.lit(suffix)), bare).otherwise(F.concat(bare, F.lit(suffix)))


def exchange_symbol(symbol: Column, suffix: str = "USDT") -> Column:
    """The second exchange's form: BASE_QUOTE."""
    return F.regexp_replace(plain_symbol(symbol), f"{suffix}$", f"_{suffix}")


def exchange_interval(interval: Column) -> Column:
    """The second exchange's name of a width; the narrowest where it has none."""
    names = F.create_map(*[F.lit(x) for pair in EXCHANGE_WIDTHS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, interval), F.lit("Min1"))


def resolve_sources(symbols: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """symbol, source: "binance" if the first listing has it, else "mexc" if the second has, else "invalid"."""
    tag = lambda df, name: df.select("symbol").distinct().withColumn(name, F.lit(name))
    joined = symbols.select("symbol").distinct().join(tag(first, "binance"), "symbol", "left").join(tag(second, "mexc"), "symbol", "left")
    return joined.select("symbol", F.coalesce("binance", "mexc", F.lit("invalid")).alias("source"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of text files with one JSON object in a line."""
    return messages(spark.read.text(path))


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream: files that land in a folder, so many in a micro-batch at most, none dropped."""
    return messages(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))
