"""Divergence between price and indicators: the two-bar form, and pairs of swings.

A key's swings are found in its last HISTORY bars, so all that is gathered per key is bounded by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.bars import tail
from tapewright.operators.blocks import series
from tapewright.plans.dims import HISTORY, KEY

# Indicators of the two-bar form and their letters, in order.
SIMPLE = (("MFI", "M"), ("RSI", "R"), ("MCD", "M"), ("Net_Volume", "V"), ("CCI", "C"), ("CMF", "C"), ("WIL", "W"), ("+DI", "D"))
SWING_INDICATORS = ("RSI", "MFI", "MCD", "RSM", "SMI")
FAST_WIDTHS = ("1m", "3m", "5m")
KEPT_SWINGS, RECENT_BARS, NEAREST, CONFIRM, LEAST_STRENGTH, LEAST_ROWS = 10, 50, 10, 3, 0.05, 50
CLASSES = ("REG_BULLISH", "REG_BEARISH", "HID_BULLISH", "HID_BEARISH")


def simple_divergence(df: DataFrame) -> DataFrame:
    """DIV of blocked rows with the SIMPLE columns: a marker for each indicator that moved against the close since the row before, and the confidence.

    An indicator up with the close down counts as bearish, the other way round as bullish. A dash where none moved so.
    """
    before = {f"_b{i}": F.lag(f"`{c}`").over(series()) for i, (c, _) in enumerate(SIMPLE)}
    df = df.withColumns({**before, "_bc": F.lag("close").over(series())})
    sides = []
    for i, (c, _) in enumerate(SIMPLE):
        now, then = F.col(f"`{c}`"), F.col(f"_b{i}")
        sides.append(F.when((now > then) & (F.col("close") < F.col("_bc")), -1).when((now < then) & (F.col("close") > F.col("_bc")), 1).otherwise(0))
    score = sum(sides[1:], sides[0])
    marks = F.filter(F.array(*[F.when(s == -1, f"🔴{m}").when(s == 1, f"🟢{m}") for s, (_, m) in zip(sides, SIMPLE, strict=True)]), lambda x: x.isNotNull())
    level = F.when(F.abs(score) >= 3, "H").when(F.abs(score) == 2, "M").otherwise("L")
    return df.withColumn("DIV", F.when(F.size(marks) == 0, "➖").otherwise(F.concat(F.concat_ws("|", marks), F.lit("("), level, F.lit(")"))))


def swing_window() -> Column:
    return F.when(F.col("interval").isin(*FAST_WIDTHS), 5).otherwise(7)


def swing_distance() -> Column:
    return F.when(F.col("interval").isin(*FAST_WIDTHS), 8).otherwise(12)


def gathered(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """key, _rows, _len and the context of the newest row: the last HISTORY rows of each key as one array of struct(pos, columns).

    last_close is the newest close, confirm_change that less the one CONFIRM - 1 rows before, close_range_atr the mean
    over 14 rows of the range of the closes of 14 rows. One exchange by key serves the ranking and the grouping.
    """
    own = Window.partitionBy(*KEY).orderBy("ts")
    span = own.rowsBetween(-13, 0)
    rows = tail(df, HISTORY).withColumn("_pos", F.row_number().over(own) - 1)
    rows = rows.withColumn("_range", F.when(F.count("close").over(span) == 14, F.max("close").over(span) - F.min("close").over(span)))
    rows = rows.withColumns({"_atr": F.when(F.count("_range").over(span) == 14, F.avg("_range").over(span)), "_change": F.col("close") - F.lag("close", CONFIRM - 1).over(own)})
    point = F.struct(F.col("_pos").cast("int").alias("pos"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    newest = F.max_by(F.struct(F.col("close").alias("last_close"), F.col("_change").alias("confirm_change"), F.col("_atr").alias("close_range_atr")), "_pos")
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(point)).alias("_rows"), F.count("*").cast("int").alias("_len"), newest.alias("_newest"))


def extrema(values: Column, n: Column, highs: bool) -> Column:
    """Of an array of struct(pos, value) those whose value is above (or below) all of the n before and the n behind it. The first and last never are."""
    most = F.array_max if highs else F.array_min

    def beats(x: Column, others: Column) -> Column:
        limit = most(F.transform(others, lambda y: y["value"]))
        return F.coalesce(x["value"] > limit if highs else x["value"] < limit, F.lit(False))

    return F.filter(values, lambda x, i: beats(x, F.slice(values, F.greatest(i - n, F.lit(0)) + 1, F.least(n, i))) & beats(x, F.slice(values, i + 2, n)))


def spaced(points: Column, distance: Column) -> Column:
    """Of an ordered array of struct(pos, value) those that are at least `distance` behind the last one kept."""
    empty = F.array().cast("array<struct<pos:int,value:double>>")
    far = lambda kept, x: (F.size(kept) == 0) | (x["pos"] - F.element_at(kept, -1)["pos"] >= distance)
    return F.aggregate(points, empty, lambda kept, x: F.when(F.coalesce(far(kept, x), F.lit(True)), F.concat(kept, F.array(x))).otherwise(kept))


def with_swings(lists: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """lists (of gathered) with _h, _l and _known of each column by its place: the last KEPT_SWINGS spaced highs and lows of the last RECENT_BARS bars, and how many values are known."""
    value = lambda c: F.transform(F.filter("_rows", lambda x: x[c].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), x[c].alias("value")))
    lists = lists.withColumns({f"_v{i}": value(c) for i, c in enumerate(columns)})

    def chosen(values: Column, highs: bool) -> Column:
        late = F.filter(spaced(extrema(values, swing_window(), highs), swing_distance()), lambda x: x["pos"] >= F.col("_len") - RECENT_BARS)
        return F.slice(late, F.greatest(F.size(late) - KEPT_SWINGS + 1, F.lit(1)), KEPT_SWINGS)

    found = {f"_{side}{i}": chosen(F.col(f"_v{i}"), side == "h") for i in range(len(columns)) for side in "hl"}
    return lists.withColumns({**found, **{f"_known{i}": F.size(f"_v{i}") for i in range(len(columns))}})


def swings(df: DataFrame, column: str) -> DataFrame:
    """key, highs, lows: arrays of struct(pos, value) of a column's swings."""
    return with_swings(gathered(df, (column,)), (column,)).select(*KEY, F.col("_h0").alias("highs"), F.col("_l0").alias("lows"))


def nearest(points: Column, pos: Column) -> Column:
    """struct(distance, pos, value) of the nearest point, of two the earlier; null where none is within NEAREST rows."""
    close = F.filter(F.transform(points, lambda q: F.struct(F.abs(q["pos"] - pos).alias("distance"), q["pos"].alias("pos"), q["value"].alias("value"))), lambda q: q["distance"] <= NEAREST)
    return F.array_min(close)


def _pairs(points: Column, others: Column) -> Column:
    """All ordered pairs of swings with their indicator's nearest swings: array of struct(i, j, p1, p2, q1, q2)."""
    n = F.size(points)
    index = F.when(n > 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def row(i: Column, j: Column) -> Column:
        a, b = F.element_at(points, i), F.element_at(points, j)
        qa, qb = nearest(others, a["pos"]), nearest(others, b["pos"])
        return F.struct(i.alias("i"), j.alias("j"), a["value"].alias("p1"), b["value"].alias("p2"), qa["value"].alias("q1"), qb["value"].alias("q2"))

    return F.flatten(F.transform(index, lambda i: F.transform(F.filter(index, lambda j: j > i), lambda j: row(i, j))))


def best_pairs(lists: DataFrame) -> DataFrame:
    """key, _newest and pairs, an array of struct(indicator, class, p1, p2, q1, q2, strength, swing_price): the strongest divergence of each indicator and class.

    lists is of gathered, with close and the SWING_INDICATORS.
    """
    lists = with_swings(lists, ("close", *SWING_INDICATORS))
    parts = []
    for i, name in enumerate(SWING_INDICATORS, 1):
        usable = lambda c, i=i: F.when(F.col(f"_known{i}") >= LEAST_ROWS, F.col(f"{c}{i}"))
        parts.append(F.struct(F.lit(name).alias("indicator"), _pairs(F.col("_l0"), usable("_l")).alias("low"), _pairs(F.col("_h0"), usable("_h")).alias("high")))
    kinds = {
        "REG_BULLISH": ("low", lambda x: (x["p2"] < x["p1"]) & (x["q2"] > x["q1"])),
        "HID_BULLISH": ("low", lambda x: (x["p2"] > x["p1"]) & (x["q2"] < x["q1"])),
        "REG_BEARISH": ("high", lambda x: (x["p2"] > x["p1"]) & (x["q2"] < x["q1"])),
        "HID_BEARISH": ("high", lambda x: (x["p2"] < x["p1"]) & (x["q2"] > x["q1"])),
    }

    def rated(x: Column) -> Column:
        strength = (F.try_divide(F.abs(x["p2"] - x["p1"]), F.abs(x["p1"])) + F.try_divide(F.abs(x["q2"] - x["q1"]), F.abs(x["q1"]))) / 2
        return F.struct(strength.alias("strength"), (-x["i"]).alias("i"), (-x["j"]).alias("j"), *[x[c].alias(c) for c in ("p1", "p2", "q1", "q2")])

    def best(part: Column, name: str) -> Column:
        side, test = kinds[name]
        top = F.array_max(F.filter(F.transform(F.filter(part[side], test), rated), lambda r: r["strength"] > LEAST_STRENGTH))
        price = top["p2"] if name.startswith("REG") else top["p1"]
        return F.when(top.isNotNull(), F.struct(part["indicator"].alias("indicator"), F.lit(name).alias("class"), *[top[c].alias(c) for c in ("p1", "p2", "q1", "q2", "strength")], price.alias("swing_price")))

    lists = lists.select(*KEY, "_newest", F.array(*parts).alias("_parts"))
    found = F.flatten(F.transform("_parts", lambda part: F.array(*[best(part, name) for name in kinds])))
    return lists.select(*KEY, "_newest", F.filter(found, lambda x: x.isNotNull()).alias("pairs"))


def divergence_pairs(df: DataFrame) -> DataFrame:
    """The strongest divergence of each key, indicator and class: key, indicator, class, p1, p2, q1, q2, strength, swing_price.

    df: rows with close and the SWING_INDICATORS. An indicator with fewer than LEAST_ROWS known values takes no part;
    pairs whose first indicator value is 0, and those not stronger than LEAST_STRENGTH, are left out. Of equals the first
    pair stays.
    """
    found = best_pairs(gathered(df, ("close", *SWING_INDICATORS)))
    return found.select(*KEY, F.explode("pairs").alias("x")).select(*KEY, "x.*")


def trade(close: Column, swing: Column, atr: Column, strength: Column, bullish: Column) -> Column:
    """struct(entry_price, stop_loss, target_price, risk_amount, reward_amount, risk_reward, atr) of a divergence.

    Entry at the close; the stop lies half an ATR beyond the swing, the target a multiple of the risk away from the entry,
    the greater the stronger the divergence. risk_reward is 0.5 to 5, and 0 without risk.
    """
    stop = F.when(bullish, swing - atr / 2).otherwise(swing + atr / 2)
    risk = F.abs(close - stop)
    multiple = F.when(strength > 0.15, 3.0).when(strength > 0.10, 2.5).otherwise(2.0)
    target = close + F.when(bullish, 1).otherwise(-1) * risk * multiple
    reward = F.abs(target - close)
    rate = F.when(risk > 0, F.least(F.greatest(reward / risk, F.lit(0.5)), F.lit(5.0))).otherwise(0.0)
    values = {"entry_price": close, "stop_loss": stop, "target_price": target, "risk_amount": risk, "reward_amount": reward, "risk_reward": rate, "atr": atr}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _traded(found: DataFrame) -> DataFrame:
    """key, the newest row's context, and x (indicator, class and levels, with t: trade) for each best pair; a row of nulls for a key without."""
    pairs = found.select(*KEY, "_newest.*", F.explode_outer("pairs").alias("x")).select(*KEY, "last_close", "confirm_change", "x.*", F.coalesce("close_range_atr", F.lit(0.0)).alias("_atr"))
    bullish = F.col("class").endswith("BULLISH")
    own = F.when(F.col("class").isNotNull(), trade(F.col("last_close"), F.col("swing_price"), F.col("_atr"), F.col("strength"), bullish))
    return pairs.withColumns({"_bull": bullish, "t": own})


def trade_levels(df: DataFrame) -> DataFrame:
    """Entry, stop, target, risk and reward of each key's strongest divergence by indicator and class. df: as for divergence_pairs."""
    rows = _traded(best_pairs(gathered(df, ("close", *SWING_INDICATORS)))).where(F.col("class").isNotNull())
    return rows.select(*KEY, "indicator", "class", "t.*")


def divergence_consensus(df: DataFrame) -> DataFrame:
    """One row for each key: counts by class, confirmed counts, mean strength, greatest risk/reward, and the consensus with its text."""
    pairs = _traded(best_pairs(gathered(df, ("close", *SWING_INDICATORS))))
    confirmed = F.coalesce(F.when(F.col("_bull"), F.col("confirm_change") > 0).otherwise(F.col("confirm_change") < 0), F.lit(False))
    pairs = pairs.withColumns({"_confirmed": confirmed & F.col("class").isNotNull(), "_rr": F.round("t.risk_reward", 9)})
    every = pairs.groupBy(*KEY).agg(
        *[F.count_if(F.col("class") == c).alias(f"DIV_{c}") for c in CLASSES],
        F.count_if(F.col("_confirmed") & F.col("_bull")).alias("confirmed_bullish"),
        F.count_if(F.col("_confirmed") & ~F.col("_bull")).alias("confirmed_bearish"),
        F.avg("strength").alias("avg_strength"),
        F.max("_rr").alias("max_rr"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in [*[f"DIV_{c}" for c in CLASSES], "confirmed_bullish", "confirmed_bearish"]}
    every = every.withColumns({**zero, "avg_strength": F.coalesce("avg_strength", F.lit(0.0)), "max_rr": F.coalesce("max_rr", F.lit(0.0))})
    bear, bull = 2 * F.col("DIV_REG_BEARISH") + F.col("DIV_HID_BEARISH"), 2 * F.col("DIV_REG_BULLISH") + F.col("DIV_HID_BULLISH")
    consensus = (
        F.when((F.col("confirmed_bearish") >= 2) & (bear >= 3), "STRONG_BEARISH").when((F.col("confirmed_bullish") >= 2) & (bull >= 3), "STRONG_BULLISH").when(bear >= 2, "WEAK_BEARISH").when(bull >= 2, "WEAK_BULLISH").otherwise("NEUTRAL")
    )
    every = every.withColumn("DIV_CONSENSUS", consensus)
    return every.withColumn("DIVERGENCE", divergence_text())


def divergence_text() -> Column:
    """Marker, counts as (R(bear/bull)H(bear/bull), confirmed count and risk/reward; only the marker without a divergence."""
    total = sum((F.col(f"DIV_{c}") for c in CLASSES[1:]), F.col(f"DIV_{CLASSES[0]}"))
    confirmed = F.col("confirmed_bullish") + F.col("confirmed_bearish")
    mark = F.when(F.col("DIV_CONSENSUS").endswith("BEARISH"), "🔴").when(F.col("DIV_CONSENSUS").endswith("BULLISH"), "🟢").otherwise("⚪")
    counts = F.format_string("(R(%d/%d)H(%d/%d)", "DIV_REG_BEARISH", "DIV_REG_BULLISH", "DIV_HID_BEARISH", "DIV_HID_BULLISH")
    extra = F.concat(F.when(confirmed > 0, F.concat(F.lit("✓"), confirmed.cast("string"))).otherwise(""), F.when(F.col("max_rr") > 1, F.format_string(" RR:%.1f", "max_rr")).otherwise(""))
    return F.when(total == 0, mark).otherwise(F.concat(mark, counts, extra, F.lit(")")))


def divergence_style(consensus: Column) -> Column:
    """struct(colour, flash) of a consensus."""
    colour = F.when(consensus.endswith("BEARISH"), "red").when(consensus.endswith("BULLISH"), "green").otherwise("grey")
    return F.struct(colour.alias("colour"), consensus.startswith("STRONG").alias("flash"))
