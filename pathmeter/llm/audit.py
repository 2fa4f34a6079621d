"""Filter interaction audit by path counts over the subset lattice (operator 12)."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmeter.session import materialize

_SPACE = r"[ \t-\r]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of one text: short, repetitive, capitals, odd signs."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters they fail.

    Bit i of ``mask`` is the i-th letter of A to E. E is true where a row with
    the same text and a smaller key is in the table. A null text is empty, a
    null part is the empty string; a row with a null key has no smaller one, is
    none and has no label. Rows that repeat key and text are counted each.
    ``good`` and ``toxic`` count rows with a label row saying so.

    Texts are read once and leave the scan as digests. Copies are counted per
    (text, part, label) with their smallest key before any shuffle by text, so
    a text with very many copies is a few rows there.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(text_filters(content).values())]
    rows = docs.select(
        F.col(key).alias("id"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        sum(bits[1:], bits[0]).alias("mask"),
    )
    rows = materialize(rows, "audit-rows")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    named = rows.where(F.col("id").isNotNull()).join(known, "id", "left")
    named = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = named.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("stay", F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    copies = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n")),
    )
    split = groups.select("part", "good", "toxic", F.explode(copies).alias("c")).select("part", "good", "toxic", "c.*")
    nameless = rows.where(F.col("id").isNull()).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    every = split.unionByName(nameless.withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    return every.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """(reaching, leaving): orders of n filters up to, and on from, every set of applied ones.

    Sets are bit masks. Forward, a set is reached by the orders that reach it
    without one of its filters; backward, it is left by those that leave it with
    one more.
    """
    full = (1 << n) - 1
    reaching, leaving = [0] * (full + 1), [0] * (full + 1)
    reaching[0] = leaving[full] = 1
    for s in range(1, full + 1):
        reaching[s] = sum(reaching[s ^ 1 << i] for i in range(n) if s >> i & 1)
    for s in range(full - 1, -1, -1):
        leaving[s] = sum(leaving[s | 1 << i] for i in range(n) if not s >> i & 1)
    return reaching, leaving


def _edges(spark: SparkSession, n: int) -> DataFrame:
    """What a row failing ``mask`` means on the edge from ``state`` by filter ``f``: 2^n * n * 2^(n-1) rows."""
    reaching, leaving = path_counts(n)
    rows = []
    for mask in range(1 << n):
        for state in range(1 << n):
            for f in range(n):
                bit = 1 << f
                if state & bit:
                    continue
                before, fails = bool(mask & state), bool(mask & bit)
                rows.append({
                    "mask": mask, "state": state, "f": f, "orders": reaching[state] * leaving[state | bit],
                    "kept": int(not before and not fails), "removed": int(fails and not before),
                    "redundant": int(fails and before), "unique": int(mask == bit),
                })
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def _steps(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, state, f) of every order: the edges it takes."""
    rows = []
    for order in permutations(range(len(letters))):
        name, state = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append({"filter_order": name, "step": step, "state": state, "f": f})
            state |= 1 << f
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each filter removes at each step of every order, per part of ``counts``.

    ``counts`` is (part, mask, n, good, toxic). A part's rows are summed once
    per edge of the lattice of applied filters; the orders are read from the
    edges, and an edge's removals times the orders that pass it add up to the
    filter's Shapley value (times the number of orders). Both tables of the
    lattice depend on the number of filters only (2,560 and 600 rows for five);
    more than seven are refused.
    """
    if len(letters) > 7:
        raise ValueError("the orders of more than seven filters are too many to list")
    spark = counts.sparkSession
    hits = counts.join(_edges(spark, len(letters)), "mask")
    total = lambda weight, of: F.sum(F.col(weight) * F.col(of))
    edges = hits.groupBy("part", "state", "f", "orders").agg(
        total("kept", "n").alias("kept"), total("removed", "n").alias("removed"),
        total("redundant", "n").alias("redundant"), total("unique", "n").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"),
    )
    passed = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "f"))
    edges = edges.withColumn("shapley", passed)
    return edges.join(_steps(spark, letters), ["state", "f"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


ORACLE_SQL = """
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
    ), w AS (
        SELECT *, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM d
    ), l AS (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
    ), f AS (
        SELECT part, doc_id,
            (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
            + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
            + 8 * regexp_matches(t, '[#$%&*|]')::INT
            + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
        FROM w
    ), c AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
    ), x AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
    ), o AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
            [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM x a, x b, x c, x d, x e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
    ), s AS (
        SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS f, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before
        FROM o, unnest([1, 2, 3, 4, 5]) AS u(i)
    ), r AS (
        SELECT part, filter_order, step, f,
            coalesce(sum(n) FILTER (mask & (before | f) = 0), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & before > 0 AND mask & f > 0), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS good_lost,
            coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS toxic_lost
        FROM c, s GROUP BY ALL
    )
    SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""
