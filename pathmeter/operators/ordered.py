"""Order-dependent operators that never put a whole key into one task.

A plain window partitioned by a key sorts all rows of that key in one task, so
a site holding a third of the rows would stall the job. Here positions are cut
into chunks of bounded length. Bounded frames get the few rows they need from
the chunk before (a halo), unbounded ones get a per-chunk summary carried
forward; summaries are themselves scanned in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmeter import session
from pathmeter.params import CHUNK


def whole_div(pos: str, size: int) -> Column:
    """Integer quotient, exact for any long."""
    return F.expr(f"`{pos}` div {int(size)}L")


def add_halo(df: DataFrame, keys: list[str], pos: str, back: int, chunk: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and repeat the last ``back`` positions before a chunk in
    it, marked by ``_halo``.

    ``pos`` may have gaps: what is repeated are the last positions that occur,
    however far back, so windows over rows do not depend on ``chunk``.
    """
    if back <= 0:
        raise ValueError("the halo must hold a row")
    home = whole_div(pos, chunk)
    copies = F.when(_at_end(pos, back, chunk), F.array(home, home + 1)).otherwise(F.array(home))
    if _has_gaps(df, keys, pos, back, chunk):
        further = session.materialize(_over_gaps(df, keys, pos, back, chunk), "gaps")
        df = df.join(further, [*keys, pos], "left")
        copies = F.concat(copies, F.coalesce("_further", F.array().cast("array<bigint>")))
    placed = df.withColumn("_chunk", F.explode(copies)).withColumn("_halo", F.col("_chunk") != home)
    return placed.drop("_further")


def _at_end(pos: str, back: int, chunk: int) -> Column:
    return F.pmod(F.col(pos), F.lit(chunk)) >= chunk - back


def _has_gaps(df: DataFrame, keys: list[str], pos: str, back: int, chunk: int) -> bool:
    """Whether some chunk but the last of its key lacks one of its last ``back`` positions.

    Reads keys and positions only. Chunks and keys are counted by aggregates
    with partial sums, and a single flag comes to the driver. Where this says
    no, the positions that are repeated in the next chunk are all there is to
    repeat.
    """
    if back > min(chunk, 62):
        return True
    slot = (F.pmod(F.col(pos), F.lit(chunk)) - (chunk - back)).cast("int")
    full = (1 << back) - 1
    ends = df.where(F.col(pos).isNotNull()).groupBy(*keys, whole_div(pos, chunk).alias("_chunk")).agg(
        F.bit_or(F.when(slot >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)).otherwise(0)).alias("_seen")
    )
    thin = F.col("_seen") != full
    spans = ends.groupBy(*keys).agg(
        (F.max("_chunk") - F.min("_chunk") + 1 > F.count(F.lit(1))).alias("_missing"),
        (F.count_if(thin) > F.max_by(thin.cast("int"), "_chunk")).alias("_thin"),
    )
    return bool(spans.agg(F.bool_or(F.col("_missing") | F.col("_thin"))).first()[0])


def _newest(positions: Column, back: int) -> Column:
    return F.slice(F.sort_array(positions, asc=False), 1, back)


def _over_gaps(df: DataFrame, keys: list[str], pos: str, back: int, chunk: int) -> DataFrame:
    """(keys, pos, _further): the chunks beyond the next one, or reached from
    before the end of their own, that need a position because of gaps.

    Only keys and positions are read, and a chunk has at most ``chunk`` of them.
    """
    lists = df.groupBy(*keys, whole_div(pos, chunk).alias("_chunk")).agg(
        _newest(F.collect_set(pos), back).alias("_last")
    )
    carried = _carried(lists, keys, "_chunk", back).select(
        *keys, F.col("_chunk").alias("_into"), F.explode("_carry").alias(pos)
    )
    usual = (whole_div(pos, chunk) + 1 == F.col("_into")) & _at_end(pos, back, chunk)
    return carried.where(~usual).groupBy(*keys, pos).agg(F.collect_list("_into").alias("_further"))


def _carried(
    lists: DataFrame, keys: list[str], at: str, back: int, block: int = CHUNK, levels: int = 2
) -> DataFrame:
    """Add ``_carry``, the newest ``back`` of the positions ``_last`` in the rows
    of the key before this one; scanned within blocks, then over blocks."""
    frame = Window.orderBy(at).rowsBetween(-back, -1)
    if levels <= 1:
        return lists.withColumn(
            "_carry", _newest(F.flatten(F.collect_list("_last").over(frame.partitionBy(*keys))), back)
        )
    name = f"_block{levels}"
    blocked = lists.withColumn(name, whole_div(at, block))
    inner = blocked.withColumn("_inner", F.flatten(F.collect_list("_last").over(frame.partitionBy(*keys, name))))
    totals = blocked.groupBy(*keys, name).agg(_newest(F.flatten(F.collect_list("_last")), back).alias("_last"))
    before = _carried(totals, keys, name, back, block, levels - 1).select(*keys, name, "_carry")
    return (
        inner.join(before, [*keys, name])
        .withColumn("_carry", _newest(F.concat("_inner", "_carry"), back))
        .drop(name, "_inner")
    )


def trailing_mean(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column | str,
    rows: int,
    out: str,
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean over the last ``rows`` rows of each key (fewer at the start), whatever
    the gaps in ``pos``, which is unique per key."""
    value = F.col(value) if isinstance(value, str) else value
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-(rows - 1), 0)
    return (
        add_halo(df, keys, pos, rows - 1, chunk)
        .withColumn(out, F.avg(value).over(window))
        .where(~F.col("_halo"))
        .drop("_chunk", "_halo")
    )


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: str,
    how: str,
    out: str,
    block: int = CHUNK,
    levels: int = 2,
) -> DataFrame:
    """``sum`` or ``max`` of ``value`` over the rows of the key **before** this one.

    With ``max`` over ``struct(pos, payload)`` this is "the latest payload
    before this row". Rows are scanned within blocks of positions and the block
    totals are scanned in turn, ``levels`` times.
    """
    return prefix_scans(df, keys, pos, {out: (value, how)}, block, levels)


def prefix_scans(
    df: DataFrame, keys: list[str], pos: str, scans: dict[str, tuple[str, str]], block: int = CHUNK, levels: int = 2
) -> DataFrame:
    """Several :func:`prefix_scan` at once, given as out: (value, how)."""
    aggs = {"sum": F.sum, "max": F.max}
    if levels <= 1:
        window = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({out: aggs[how](value).over(window) for out, (value, how) in scans.items()})
    at = f"_block{levels}"
    total, carry, inner = ({out: f"_{n}{levels}_{out}" for out in scans} for n in ("total", "carry", "inner"))
    blocked = df.withColumn(at, whole_div(pos, block))
    window = Window.partitionBy(*keys, at).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, at).agg(*[aggs[how](value).alias(total[out]) for out, (value, how) in scans.items()])
    over_blocks = {carry[out]: (total[out], how) for out, (_, how) in scans.items()}
    carries = prefix_scans(totals, keys, at, over_blocks, block, levels - 1)
    merged = {}
    for out, (value, how) in scans.items():
        here, before = F.col(inner[out]), F.col(carry[out])
        if how == "sum":
            merged[out] = F.coalesce(here + before, here, before)
        elif _ascending_payload(df, value):
            merged[out] = F.coalesce(here, before)
        else:
            merged[out] = F.greatest(here, before)
    return (
        blocked.withColumns({inner[out]: aggs[how](value).over(window) for out, (value, how) in scans.items()})
        .join(carries.select(*keys, at, *carry.values()), [*keys, at])
        .withColumns(merged)
        .drop(at, *carry.values(), *inner.values())
    )


def _ascending_payload(df: DataFrame, value: str) -> bool:
    """Structs led by a position grow with it, so the inner value always wins."""
    return df.schema[value].dataType.typeName() == "struct"


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Running number from 1 per key in ``order``, whatever the gaps and however
    the rows lie.

    Rows are range-partitioned by key and order, so a hot key, or a hot moment
    of one, is cut over many tasks. The sorted rows are stored with their place;
    the counts of a key in the partitions before then shift its local numbers.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    stored = session.materialize(placed, "numbered")
    parts = stored.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    offsets = prefix_scan(parts, keys, "_part", "_n", "sum", "_before", levels=1)
    number = F.col("_row") - F.col("_first") + F.coalesce("_before", F.lit(0)) + 1
    return (
        stored.join(offsets.drop("_n"), [*keys, "_part"])
        .withColumn(out, number)
        .drop("_part", "_row", "_first", "_before")
    )


def run_length(
    df: DataFrame, keys: list[str], pos: str, value: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Rows in the current run of equal ``value`` ending at each row.

    ``pos`` is unique per key and may have gaps; rows are counted, not
    positions. A run starts where the value differs from the row before. Chunks
    number their rows; the rows before a chunk, the value it continues and the
    start of the run it continues are scanned over one summary row per chunk.
    Rows and summaries are stored, as several steps read them.
    """
    step = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    changed = (F.col("_row") > 1) & ~F.lag(value).over(step).eqNullSafe(F.col(value))
    rows = (
        df.withColumn("_chunk", whole_div(pos, chunk))
        .withColumn("_row", F.row_number().over(step).cast("bigint"))
        .withColumn("_start", F.when(changed, F.col("_row")))
        .withColumn("_start", F.max("_start").over(step.rowsBetween(Window.unboundedPreceding, 0)))
    )
    rows = session.materialize(rows, "runs")
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_start").alias("_last"),
        F.min_by(F.struct(value), pos).alias("_first_value"),
        F.struct(F.max("_chunk").alias("at"), F.max_by(F.struct(value), pos).alias("of")).alias("_last_value"),
    )
    ends = session.materialize(ends, "run-ends")
    ends = prefix_scans(ends, keys, "_chunk", {"_skip": ("_n", "sum"), "_before": ("_last_value", "max")})
    skip = F.coalesce("_skip", F.lit(0))
    new = ~F.coalesce(F.col("_before.of").eqNullSafe(F.col("_first_value")), F.lit(False))
    ends = ends.withColumns(
        {"_skip": skip, "_fresh": F.when(new, skip + 1), "_opened": F.coalesce(skip + F.col("_last"), F.when(new, skip + 1))}
    )
    ends = prefix_scan(ends, keys, "_chunk", "_opened", "max", "_carry")
    carries = ends.select(*keys, "_chunk", "_skip", F.coalesce("_fresh", "_carry").alias("_open"))
    begin = F.coalesce(F.col("_skip") + F.col("_start"), F.col("_open"))
    return (
        rows.join(carries, [*keys, "_chunk"])
        .withColumn(out, F.col("_skip") + F.col("_row") - begin + 1)
        .drop("_chunk", "_row", "_start", "_skip", "_open")
    )
