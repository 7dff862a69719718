"""Long series in blocks of rows, so that no task ever holds the whole history of a key.

A window over (symbol, interval) would put all rows of a hot key into one task. Here each row gets its number in its
series by counting in time segments first, and rows go to blocks of BLOCK_ROWS; the last HALO_ROWS of a block also go
to the next one, where they only serve as what stands before. Windows of up to HALO_ROWS rows are then exact.

Running sums and exponential averages look back over the whole series. They are recurrences y = a y + b, and such maps
compose: a block is cut into chunks, in which a scaled running sum gives y from a start of 0; the chunks' ends, one row
for each block, are folded over the blocks into every chunk's start, which is then put in. So they are exact whatever
the span, without a halo and without a Python worker.

The blocks are checkpointed as they are dealt out and sorted: all windows and groups by block that follow need neither
an exchange nor a sort, and plans stay straight lines, however many of the recurrences build on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tapewright.operators.shared import held
from tapewright.plans.dims import KEY, seconds

BLOCK_ROWS, HALO_ROWS = 1 << 15, 1536
#: Rows of a chunk, at most: a ** -CHUNK_ROWS must be a double, which holds for averages of 3 rows and more.
CHUNK_ROWS = 512
#: Blocks before a block that count for its start; what lies further back has no weight left in a double, unless a is 1.
LOOK_BACK = 1024
#: Bars in one segment, at most, while rows are numbered.
SEGMENT_ROWS = 4096
PARTITION = (*KEY, "_block")


def segment(ts: str = "ts") -> Column:
    """The time segment of a bar: whole days, about SEGMENT_ROWS bars of its width."""
    days = F.greatest(F.lit(1), F.floor(F.coalesce(seconds(), F.lit(60)) * SEGMENT_ROWS / 86400).cast("int"))
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / days)


def numbered(rows: DataFrame, key: tuple[str, ...] = KEY, order: tuple[str | Column, ...] = ("ts",), cut: Column | None = None) -> DataFrame:
    """rows with _rn, the row's number in its series from 1 in the order given, and _rows, the length of the series.

    cut: a number that rises with the order and puts not too many rows of a key together; by default the time segment.
    """
    cut_rows = rows.withColumn("_segment", segment() if cut is None else cut)
    counts = cut_rows.groupBy(*key, "_segment").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "_segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_rows"))
    own = F.row_number().over(Window.partitionBy(*key, "_segment").orderBy(*order))
    return cut_rows.withColumn("_own", own).join(offsets, [*key, "_segment"]).withColumn("_rn", F.col("_own") + F.col("_before")).drop("_segment", "_own", "_before")


def blocked(bars: DataFrame, rows: int = BLOCK_ROWS, halo: int = HALO_ROWS) -> DataFrame:
    """numbered bars with _block and _halo, dealt out by series and block, sorted, and checkpointed.

    _chunk and _place number a block's chunks (through the whole series) and the rows in them; _chunk_rows and
    _block_rows are their lengths.
    """
    at = (F.col("_rn") - 1) % rows
    block = F.floor((F.col("_rn") - 1) / rows)
    own = F.struct(block.alias("_block"), F.lit(False).alias("_halo"))
    also = F.struct((block + 1).alias("_block"), F.lit(True).alias("_halo"))
    copies = F.when((at >= rows - halo) & (F.col("_rn") < F.col("_rows")), F.array(own, also)).otherwise(F.array(own))
    dealt = numbered(bars).withColumn("_copy", F.explode(copies)).select("*", "_copy.*").drop("_copy")
    size = max(n for n in range(1, CHUNK_ROWS + 1) if rows % n == 0 and halo % n == 0)
    chunks = {"_chunk": F.floor((F.col("_rn") - 1) / size), "_place": (F.col("_rn") - 1) % size, "_chunk_rows": F.lit(size), "_block_rows": F.lit(rows)}
    # bars of one width have it as a literal, which the optimizer would put in place of the column in what the checkpoint is partitioned by
    kept = F.when(F.col("symbol").isNull(), F.col("interval")).otherwise(F.concat("interval", F.substring("symbol", 1, 0)))
    return held(dealt.withColumns(chunks).withColumn("interval", kept).repartition(*PARTITION).sortWithinPartitions(*PARTITION, "_chunk", "_rn"))


def series() -> WindowSpec:
    """The one window that all series functions use; blocks are dealt out and sorted for it."""
    return Window.partitionBy(*PARTITION).orderBy("_chunk", "_rn")


def last(n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return series().rowsBetween(1 - n, 0)


def full(value: Column, n: int) -> Column:
    """A value that needs n rows: null before the series has so many."""
    return F.when(F.col("_rn") >= n, value)


def recurrences(df: DataFrame, steps: dict[str, tuple[Column, Column | float]]) -> DataFrame:
    """df (blocked) with y = a * (y of the row before) + b over the whole series for each {y: (b, a)}; y begins with 0, nulls of b count as 0.

    a is a number above 0.4 and at most 1, or a column that is the same for all rows of a key and depends on the key
    alone. All of them together cost one aggregate by block and one join by block with a row for each.
    """
    own = {f"_b{i}": b for i, (b, _) in enumerate(steps.values())} | {f"_a{i}": a for i, (_, a) in enumerate(steps.values()) if isinstance(a, Column)}
    # the decay to some power, as SQL: a number's own, a column's, or 1 for sums
    decay = [f"_a{i}" if isinstance(a, Column) else repr(float(a)) for i, (_, a) in enumerate(steps.values())]
    power = lambda i, n: "1D" if decay[i] == "1.0" else f"power({decay[i]}, {n})"
    each = range(len(steps))
    upto = Window.partitionBy(*PARTITION, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    scaled = df.withColumns(own).withColumns({f"_b{i}": F.expr(f"coalesce(CAST(_b{i} AS double), 0D) * {power(i, '-_place')}") for i in each})
    local = scaled.withColumns({f"_y{i}": F.sum(f"_b{i}").over(upto) * F.expr(power(i, "_place")) for i in each}).drop(*[f"_b{i}" for i in each])
    ends = F.expr(f"sort_array(collect_list(CASE WHEN _place = _chunk_rows - 1 THEN struct(_chunk, {', '.join(f'_y{i}' for i in each)}) END)) AS _ends")
    same = [F.first(c).alias(c) for c in ("_chunk_rows", "_block_rows", *[c for c in own if c.startswith("_a")])]
    facts = local.where("NOT _halo").groupBy(*PARTITION).agg(ends, *same)
    fold = lambda values, a: f"aggregate({values}, 0D, (y, b) -> y * {a} + b)"
    facts = facts.withColumns({f"_w{i}": F.expr(fold(f"_ends._y{i}", power(i, "_chunk_rows"))) for i in each})
    order = f"PARTITION BY {', '.join(KEY)} ORDER BY _block"

    def start(i: int) -> Column:
        if decay[i] == "1.0":
            return F.expr(f"coalesce(sum(_w{i}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)")
        before = f"collect_list(_w{i}) OVER ({order} ROWS BETWEEN {LOOK_BACK} PRECEDING AND 1 PRECEDING)"
        return F.expr(fold(before, power(i, "_block_rows")))

    facts = facts.withColumns({f"_c{i}": start(i) for i in each})
    facts = facts.withColumns({f"_o{i}": F.expr(f"aggregate(_ends._y{i}, array(_c{i}), (done, b) -> concat(done, array(element_at(done, -1) * {power(i, '_chunk_rows')} + b)))") for i in each})
    # the halo's chunks are the last ones of the block before; the first block has none
    chunks = "CAST(_block_rows / _chunk_rows AS int)"
    starts = {f"_s{i}": F.expr(f"concat(coalesce(slice(lag(_o{i}) OVER ({order}), 1, {chunks}), array_repeat(0D, {chunks})), _o{i})") for i in each}
    facts = held(facts.withColumns(starts).select(*PARTITION, *starts))
    place = f"CAST(_chunk - (_block - 1) * {chunks} AS int)"
    values = {y: F.expr(f"_y{i} + get(_s{i}, {place}) * {power(i, '_place + 1')}") for i, y in enumerate(steps)}
    return local.join(facts, list(PARTITION)).withColumns(values).drop(*[f"_{k}{i}" for i in each for k in "yas"])


def running_sum(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """df (blocked) with running sums over the whole series: {new column: column}. Nulls count as 0."""
    return recurrences(df, {out: (F.col(f"`{c}`"), 1.0) for out, c in values.items()})


def finished(df: DataFrame) -> DataFrame:
    """Without halo rows and helper columns."""
    return df.where(~F.col("_halo")).drop(*[c for c in df.columns if c.startswith("_")])
