"""Exact top-k inner products over norm buckets (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmeter.llm.vectors import finite, matrix
from pathmeter.session import materialize

#: Length buckets, each with as many rows.
BUCKETS = 16
#: Candidate rows of a bucket that one task compares, and queries it compares them with.
PART_ROWS = 16_384
PART_QUERIES = 8_192
#: Longest candidates that give each query a first score to beat.
SEED_ROWS = 1_024
#: Coordinates of a query tried by coordinate pruning.
FOCUS = 4
#: Below this local threshold coordinates prune too little, and the length alone is used.
COORDINATE_FROM = 0.35
_LONG = 2.0**63


def scaled(embedding: str, factor: int) -> F.Column:
    """floor(factor * x) of every component as long, x as double; what no long holds is an error."""
    def one(x: F.Column) -> F.Column:
        y = x.cast("double") * factor
        return F.when(F.abs(y) < _LONG, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component does not fit a long")))

    return F.transform(F.col(embedding), one)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of long vectors.

    Doubles serve where all partial sums stay below 2^53. Else longs that wrap
    around, which are exact where the product itself fits a long; whether it
    does is told by doubles and, near the border, by Python integers. A product
    that fits no long raises OverflowError.
    """
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (q, c)]
    bound = most[0] * most[1] * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    out = q @ c.T
    if bound >= _LONG:
        about = np.abs(q.astype(np.float64) @ c.astype(np.float64).T)
        for i, j in zip(*np.nonzero(about + bound * 2.0**-50 * max(1, q.shape[1]) >= _LONG)):
            exact = sum(x * y for x, y in zip(q[i].tolist(), c[j].tolist()))
            if not -(2**63) <= exact < 2**63:
                raise OverflowError("an inner product does not fit a long")
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher score first, then smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        rest = np.flatnonzero(scores >= cut)
        return rest[np.lexsort((ids[rest], -scores[rest]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def bucket_top(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best candidates of one bucket for each query that its length cannot exclude.

    ``floor`` is a score that k candidates of the query reach. With lengths |q|
    and L, the longest of the bucket, the local threshold is floor / (|q| L).
    Above 1 the bucket is left out. If high, each of the query's largest
    coordinates bounds that coordinate of a candidate's direction (the rest of
    both unit vectors can add no more than the product of their lengths); if
    low, candidates are cut by length, longest first. What is left is verified.
    """
    length = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    c_ids, c, length = c_ids[order], c[order], length[order]
    unit = c / np.where(length > 0, length, 1)[:, None]
    by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    q_length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    longest = length[0] if len(length) else 0.0
    dense: list[int] = []
    for i in range(len(q_ids)):
        reach = q_length[i] * longest
        # Without a floor above zero nothing can be excluded.
        local = floor[i] / reach * (1 - 1e-9) if floor[i] > 0 and reach > 0 else (np.inf if floor[i] > 0 else -np.inf)
        if local > 1:
            continue
        if local < COORDINATE_FROM:
            dense.append(i)
            continue
        direction = q[i] / q_length[i]
        keep = None
        for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
            if f not in by_coordinate:
                place = np.argsort(unit[:, f], kind="stable")
                by_coordinate[f] = (place, unit[place, f])
            place, values = by_coordinate[f]
            x = direction[f]
            half = np.sqrt(max(0.0, (1 - local**2) * (1 - x**2)))
            # As angles: the candidate's lies within arccos(local) of the query's; at 0 or pi the range ends.
            low = -1.0 if x <= -local else local * x - half
            high = 1.0 if x >= local else local * x + half
            part = place[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]
            if keep is None or len(part) < len(keep):
                keep = part
        if keep is not None and len(keep):
            scores = products(q[i : i + 1], c[keep])[0]
            real = (scores >= floor[i]) & (c_ids[keep] != q_ids[i])
            keep, scores = keep[real], scores[real]
            top = best(c_ids[keep], scores, k)
            if len(top):
                yield int(q_ids[i]), c_ids[keep][top], scores[top]
    for s in range(0, len(dense), 128):
        some = np.array(dense[s : s + 128])
        # Shorter candidates than the floor over the query's length cannot reach it.
        least = np.where(q_length[some] > 0, floor[some] / np.where(q_length[some] > 0, q_length[some], 1), 0).min() * (1 - 1e-9)
        reach = len(length) if least <= 0 else int(np.searchsorted(-length, -least, "right"))
        scores = products(q[some], c[:reach])
        for row, i in enumerate(some):
            real = np.flatnonzero((scores[row] >= floor[i]) & (c_ids[:reach] != q_ids[i]))
            top = real[best(c_ids[real], scores[row][real], k)]
            if len(top):
                yield int(q_ids[i]), c_ids[top], scores[row][top]


_LOWEST = np.iinfo(np.int64).min


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: int = 256, key: str = "vec_id", embedding: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """The k rows of ``vectors`` with the highest inner products for each row of ``queries``.

    Returns (query_id, rank, vec_id, score), rank from 1; scores are integer
    products of floor(factor * x), of any size a long holds (a product beyond is
    an error); ties go to the smaller id, a query's own key is no candidate. All rows, if fewer than k. Rows without a key and vectors
    that are null or hold null or non-finite components take no part; shorter
    vectors count as ending in zeros. Repeated rows count each as candidates and
    once as queries; a query key with several vectors gets the best over them.
    """
    def valid(df: DataFrame) -> DataFrame:
        ok = df.where(finite(embedding) & F.col(key).isNotNull())
        x = ok.select(F.col(key).cast("long").alias("id"), scaled(embedding, factor).alias("x"))
        return x.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))

    cands = materialize(valid(vectors), "candidates")
    asked = materialize(valid(queries).dropDuplicates(["id", "x"]), "queries")
    rows, n_queries = cands.count(), asked.count()
    edges = cands.agg(F.percentile_approx("length", F.lit([i / BUCKETS for i in range(1, BUCKETS)]), F.lit(10_000)).alias("e")).first()["e"] or []
    bucket = sum((F.when(F.col("length") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    cands = cands.withColumn("bucket", bucket)
    counts = cands.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    parts = F.create_map(*[F.lit(x) for r in counts for x in (r["bucket"], -(-r["n"] // part_rows))]) if counts else F.create_map(F.lit(0), F.lit(1))
    # A bucket is dealt in parts by key and vector, so equal vectors do not meet in one task.
    cands = cands.withColumn("part", F.pmod(F.xxhash64("id", "x"), parts[F.col("bucket")]).cast("int"))
    groups = max(1, -(-n_queries // PART_QUERIES))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(groups)).cast("int"))
    # The longest rows, a bounded number, give every query a first floor.
    first = cands.orderBy(F.desc("length"), "id").limit(SEED_ROWS).select("id", "x").collect()
    seed_ids = np.array([r["id"] for r in first], np.int64)
    seeds = vectors.sparkSession.sparkContext.broadcast((seed_ids, matrix(pd.Series([r["x"] for r in first]), np.int64)))

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, seed = seeds.value
        for frame in frames:
            made = []
            for s in range(0, len(frame), 1024):
                q, c = _same_width(matrix(frame["x"].iloc[s : s + 1024], np.int64), seed)
                score = products(q, c)
                score[frame["id"].to_numpy()[s : s + 1024, None] == ids[None, :]] = _LOWEST
                # The k-th best of some candidates is a floor for the k-th best of all.
                made.append(np.partition(score, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(q), _LOWEST))
            frame["floor"] = np.concatenate(made) if made else []
            yield frame[["id", "x", "chunk", "floor"]]

    asked = asked.select("id", "x", "chunk").mapInPandas(floors, "id long, x array<bigint>, chunk int, floor long")
    asked = materialize(asked, "floors")
    tops = {r["bucket"]: r["top"] for r in cands.groupBy("bucket").agg(F.max("length").alias("top")).collect()}
    # A query goes to the buckets whose longest row could reach its floor.
    if not counts or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = [(b["bucket"], -(-b["n"] // part_rows), float(tops[b["bucket"]])) for b in counts]
    listed = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("parts"), F.lit(t).alias("top")) for b, n, t in each])
    q_length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    sent = asked.withColumn("ql", q_length).select("id", "x", "chunk", "floor", "ql", F.explode(listed).alias("b")).select("id", "x", "chunk", "floor", "ql", "b.*")
    sent = sent.where((F.col("floor") <= 0) | (F.col("ql") * F.col("top") * (1 + 1e-9) >= F.col("floor")))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", "part", "chunk", "id", "x", "floor")
    # Candidates are copied for the chunks of which a query reaches their part, no others.
    reached = materialize(sent.select("bucket", "part", "chunk").distinct(), "reached")
    spread = cands.select("bucket", "part", "id", "x").join(reached, ["bucket", "part"]).select("bucket", "part", "chunk", "id", "x")
    by = ["bucket", "part", "chunk"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            q, c = _same_width(matrix(right["x"], np.int64), matrix(left["x"], np.int64))
            found = bucket_top(right["id"].to_numpy(), q, right["floor"].to_numpy(), left["id"].to_numpy(), c, k)
            for query, ids, scores in found:
                out += [(query, int(i), int(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    hits = spread.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
