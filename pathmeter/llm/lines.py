"""Repeated line runs by a suffix array over line ids (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pathmeter.llm.common import numbered, text_key
from pathmeter.operators.ordered import prefix_scan
from pathmeter.session import materialize

#: A repeated run counts if it holds at least so many words.
MIN_WORDS = 50
_WORD = r"[^ \t\n\x0B\f\r]+"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, idx, line binary, words) of every line; the line is its 128-bit hash."""
    doc = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), text_key(text).alias("tk"))
    split = docs.where(F.col(text) != "").select(doc.alias("doc"), F.posexplode(F.split(text, "\n")).alias("idx", "line"))
    words = F.regexp_count("line", F.lit(_WORD)).cast("int")
    return split.select("doc", "idx", F.unhex(F.md5("line")).alias("line"), words.alias("words"))


def _ranks(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense rank from 0 of the distinct values of ``order``."""
    return numbered(rows.select(*order).distinct(), order, name, "ranks")


def _segments(active: DataFrame, least: int) -> DataFrame:
    """Number the repeated lines in document order and find the shortest runs with enough words.

    Returns (p, ahead, depths, r0, doc, idx): p runs without gaps within a
    segment, a stretch of successive repeated lines of one document, and
    ``ahead`` lines of the segment follow. ``depths`` are the lengths of runs
    starting at p that reach ``least`` words, but not without their last line,
    or not without their first one. Any run with enough words is covered by such
    runs. Repeated rows of one document are one.
    """
    kind = active.schema["doc"].dataType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            doc = _documents(rows)
            done = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            if done:
                yield from _depths(rows.slice(0, done), doc[:done], least).to_batches()
            carry = rows.slice(done)
        if carry is not None and len(carry):
            yield from _depths(carry, _documents(carry), least).to_batches()

    flat = active.select("doc.none", "doc.id", "doc.tk", "idx", "words", "r0")
    flat = flat.repartitionByRange("none", "id", "tk").sortWithinPartitions("none", "id", "tk", "idx")
    made = flat.mapInArrow(run, f"none boolean, id {kind}, tk long, idx int, r0 long, ahead int, depths array<int>")
    return numbered(made, ["none", "id", "tk", "idx"], "p", "positions", placed=True)


def _documents(rows: pa.Table) -> np.ndarray:
    """Running number of the document of each row; keys are compared as they are, nulls as equal."""
    ids = rows["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    tk = rows["tk"].to_numpy()
    return np.cumsum(np.r_[0, (np.diff(ids) != 0) | (np.diff(tk) != 0)]) if len(rows) else np.zeros(0, np.int64)


def _depths(rows: pa.Table, doc: np.ndarray, least: int) -> pa.Table:
    """Segments of whole documents by array arithmetic over running word counts."""
    idx = rows["idx"].to_numpy()
    again = np.r_[False, (np.diff(doc) == 0) & (np.diff(idx) == 0)]
    rows, idx, doc = rows.filter(pa.array(~again)), idx[~again], doc[~again]
    new_doc = np.r_[True, np.diff(doc) != 0]
    n = len(idx)
    starts = new_doc | np.r_[True, np.diff(idx) != 1]
    first = np.flatnonzero(starts)
    lengths = np.diff(np.r_[first, n])
    begin = np.repeat(first, lengths)
    end = np.repeat(first + lengths - 1, lengths)
    total = np.cumsum(rows["words"].to_numpy().astype(np.int64))
    before = np.r_[0, total[:-1]]
    at = np.arange(n)
    # The shortest run that ends at a line, and the shortest that starts there.
    start = np.searchsorted(before, total - least, "right") - 1
    back = start >= begin
    stop = np.searchsorted(total, before + least, "left")
    fore = stop <= end
    pairs = np.unique(np.concatenate([
        np.stack([start[back], (at - start + 1)[back]], 1), np.stack([at[fore], (stop - at + 1)[fore]], 1),
    ]), axis=0)
    cuts = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
    made = rows.select(["none", "id", "tk", "idx", "r0"]).append_column("ahead", pa.array((end - at).astype(np.int32)))
    return made.append_column("depths", pa.ListArray.from_arrays(cuts, pa.array(pairs[:, 1].astype(np.int32))))


def _double(level: DataFrame, size: int) -> DataFrame:
    """Ranks of runs twice as long: (p, ahead, seg, r) with r the rank of the first 2 * size lines.

    The rank of a run and of the run ``size`` lines on, -1 past the end of the
    segment, are ranked as pairs.
    """
    window = Window.partitionBy("seg").orderBy("p")
    paired = level.withColumn("r2", F.coalesce(F.lead("r", size).over(window), F.lit(-1).cast("long")))
    ranks = _ranks(paired, ["r", "r2"], "rank")
    new = paired.join(ranks, ["r", "r2"]).select("p", "ahead", "seg", F.col("rank").alias("r"))
    return materialize(new, "level")


def suffix_array(positions: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the suffixes, in the order of their first ``depth`` lines or more.

    members: (p, c) of every position with depths; classes: (c, lcp), c dense
    in suffix order and lcp the lines shared with class c - 1 (counted up to
    the sorted length; 0 for the first).
    """
    level = positions.select("p", "ahead", (F.col("p") + F.col("ahead")).alias("seg"), F.col("r0").alias("r"))
    levels, size = [level], 1
    while size < depth:
        levels.append(_double(levels[-1], size))
        size *= 2
    starting = positions.where(F.size("depths") > 0).select("p")
    sorted_ = levels[-1].join(starting, "p").select("p", "ahead", "r")
    dense = _ranks(sorted_, ["r"], "c")
    members = materialize(sorted_.join(dense, "r").select("p", "ahead", "c"), "suffixes")
    classes = members.groupBy("c").agg(F.min(F.struct("p", "ahead")).alias("m")).select("c", "m.*")
    one = classes.select("c", F.col("p").alias("pa"), F.col("ahead").alias("aa"))
    two = classes.select((F.col("c") + 1).alias("c"), F.col("p").alias("pb"), F.col("ahead").alias("ab"))
    pairs = materialize(one.join(two, "c").withColumn("lcp", F.lit(0)), "lcp")
    # From long runs to short ones: where the runs agree, both sides move on by their length.
    for k in range(len(levels) - 1, -1, -1):
        a = levels[k].select((F.col("p")).alias("xa"), F.col("r").alias("ra"), F.col("ahead").alias("na"))
        b = levels[k].select((F.col("p")).alias("xb"), F.col("r").alias("rb"))
        inside = (F.col("lcp") <= F.col("aa")) & (F.col("lcp") <= F.col("ab"))
        pairs = (
            pairs.withColumn("xa", F.when(inside, F.col("pa") + F.col("lcp"))).withColumn("xb", F.when(inside, F.col("pb") + F.col("lcp")))
            .join(a, "xa", "left").join(b, "xb", "left")
        )
        more = F.least(F.lit(1 << k), F.col("na") + 1)
        pairs = pairs.select("c", "pa", "aa", "pb", "ab", F.when(F.col("ra") == F.col("rb"), F.col("lcp") + more).otherwise(F.col("lcp")).alias("lcp"))
        # Stored level by level, so that the joins of one level live at a time.
        pairs = materialize(pairs, "lcp")
    return members, pairs.select("c", "lcp")


def repeated_positions(positions: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Positions p in a run with enough words that also starts earlier.

    Suffixes are cut into LCP intervals at each depth: a class starts a new
    interval where it shares fewer lines than the depth with the class before.
    All suffixes of an interval start with the same run; the first occurrence
    stays, later ones are listed line by line.
    """
    runs = positions.select("p", F.explode("depths").alias("d")).join(members.select("p", "c"), "p")
    groups = runs.groupBy("d", "c").agg(F.min("p").alias("first"))
    marked = groups.join(classes, "c", "left").withColumn("opens", F.coalesce(F.col("lcp") < F.col("d"), F.lit(True)))
    placed = numbered(marked.select("d", "c", "first", "opens"), ["d", "c"], "n", "intervals")
    placed = placed.withColumn("start", F.when(F.col("opens"), F.col("n")))
    scanned = prefix_scan(placed, [], "n", "start", "max", "before")
    scanned = materialize(scanned.select("d", "c", "first", F.coalesce("start", "before").alias("interval")), "intervals")
    least = scanned.groupBy("interval").agg(F.min("first").alias("least"))
    firsts = scanned.join(least, "interval").select("d", "c", "least")
    later = runs.join(firsts, ["d", "c"]).where("p > least")
    return later.select(F.explode(F.sequence("p", F.col("p") + F.col("d") - 1)).alias("p")).distinct()


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Delete later copies of line runs of ``min_words`` words or more from ``text``.

    A line goes if it lies in a run of successive lines of its document that
    hold at least ``min_words`` words and occur, line for line, at an earlier
    start; earlier is by key (null last), then text, then line. The rest of the
    text stays, joined by line breaks; a text of copies only becomes empty.
    All rows and columns stay; ``length``, if there is such a column and the
    text changed, is set to the new number of characters. Null and empty texts
    stay as they are. Rows equal in key and text are one document.
    """
    lines = materialize(_lines(docs, key, text), "lines")
    repeated = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    ids = numbered(repeated, ["line"], "r0", "line-ids")
    active = lines.join(ids, "line").select("doc", "idx", "words", "r0")
    positions = _segments(active, min_words)
    longest = positions.agg(F.max(F.array_max("depths"))).first()[0]
    if longest is None:
        return docs
    members, classes = suffix_array(positions, longest)
    gone = repeated_positions(positions, members, classes)
    marks = positions.select("p", "id", "tk", "idx").join(gone, "p")
    marks = materialize(marks.groupBy(F.col("id").alias("k"), F.col("tk").alias("t")).agg(F.collect_set("idx").alias("gone")), "gone-lines")
    # Only a document's own line numbers are gathered; a key that is not in the list keeps its text.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), text_key(text).alias("tk"))
    joined = packed.join(marks.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("k")) & (F.col("tk") == F.col("t")), "left")
    cut = F.col("gone").isNotNull()
    # Texts without a mark do not leave the JVM.
    joined = joined.withColumn("rest", _without(F.when(cut, F.col("row")[text]), F.col("gone")))
    new = {text: F.when(cut, F.col("rest")).otherwise(F.col("row")[text])}
    if length in docs.columns:
        kind = docs.schema[length].dataType
        new[length] = F.when(cut, F.length("rest").cast(kind)).otherwise(F.col("row")[length])
    return joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Each text without the lines whose numbers are listed; null without a list."""
    out = []
    for text, lines in zip(texts, gone):
        if text is None or lines is None:
            out.append(None)
            continue
        parts = text.split("\n")
        stay = np.ones(len(parts), bool)
        stay[lines] = False
        out.append("\n".join([parts[i] for i in np.flatnonzero(stay).tolist()]))
    return pd.Series(out, index=texts.index, dtype=object)
