"""Near-duplicate embeddings by a forest of random-projection trees (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmeter.llm.common import components
from pathmeter.llm.vectors import finite, matrix
from pathmeter.session import materialize

#: Trees up to a depth of two levels, and further trees per level beyond, as every level parts some near rows.
TREES = 6
TREES_PER_LEVEL = 0.8
#: Rows wanted in a leaf.
LEAF_ROWS = 512
#: About this many vectors at most fix the split points of the trees; every vector is then indexed.
FIT_VECTORS = 100_000
#: And at most this many of their components, as the driver holds them.
FIT_COMPONENTS = 12_800_000
#: Leaves with more rows are split again from about LEAF_FIT rows of their own.
SPLIT_ROWS = 16_384
LEAF_FIT = 4096
#: A leaf is left whole if its parts would take more than this share of its comparisons, or lie deeper than so many levels.
WORTH = 0.5
DEEPEST = 48
#: Sampled rows a leaf has at least, so that split points stay meaningful.
LEAF_SAMPLE = 16
#: Rows on either side of a split nearer than this over sqrt(dimensions) go both ways.
SPILL = 0.16
#: Rows of a leaf compared in one task; larger leaves are dealt in parts.
PART_ROWS = 4096
_STEP = 512


@dataclass(frozen=True)
class Tree:
    """One direction per level and one split point per node, nodes numbered from 1 as in a heap."""

    directions: np.ndarray
    splits: np.ndarray


def levels(rows: int, leaf: int) -> int:
    """Levels of halving after which ``rows`` rows leave about ``leaf`` in a leaf."""
    depth = 0
    while rows / 2 ** (depth + 1) >= leaf / 2:
        depth += 1
    return depth


def _sampled_levels(wanted: int, sample: int) -> int:
    """Of the wanted levels, those after which LEAF_SAMPLE of the sampled rows are left in a leaf."""
    return min(wanted, max(0, (sample // LEAF_SAMPLE).bit_length() - 1))


def _directions(rng: np.random.Generator, depth: int, dims: int) -> np.ndarray:
    directions = rng.standard_normal((max(depth, 1), dims))
    return (directions / np.linalg.norm(directions, axis=1, keepdims=True))[:depth]


def _tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Random directions, and split points near the medians where the fewest sampled rows lie within the spill margin."""
    dims = sample.shape[1]
    margin = SPILL / np.sqrt(dims)
    directions = _directions(rng, depth, dims)
    splits = np.zeros(1 << depth)
    node = np.ones(len(sample), np.int64)
    for level in range(depth):
        along = sample @ directions[level]
        order = np.lexsort((along, node))
        bounds = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
        for n in range(1 << level, 2 << level):
            part = along[order[bounds[n - (1 << level)] : bounds[n - (1 << level) + 1]]]
            if len(part):
                tries = np.quantile(part, np.linspace(0.35, 0.65, 13))
                close = np.searchsorted(part, tries + margin) - np.searchsorted(part, tries - margin)
                splits[n] = tries[np.lexsort((np.abs(np.arange(13) - 6), close))[0]]
        node = 2 * node + (along > splits[node])
    return Tree(directions, splits)


def grow(sample: np.ndarray, rows: int, trees: int | None = None, leaf: int = LEAF_ROWS, seed: int = 4) -> list[Tree]:
    """Random splits of the unit vectors ``sample`` so deep that ``rows`` rows leave about ``leaf`` in a leaf.

    A node is split near its median, between the 35 and 65 percent quantiles,
    where the fewest sampled rows lie within the spill margin. Where the sample
    is too small for that depth the trees end before it, and ``deepen`` goes on.
    Without ``trees`` their number follows the depth wanted.
    """
    rng = np.random.default_rng(seed)
    wanted = levels(rows, leaf)
    if trees is None:
        trees = TREES + ceil(TREES_PER_LEVEL * max(0, wanted - 2))
    depth = _sampled_levels(wanted, len(sample))
    return [_tree(sample, depth, rng) for _ in range(trees)]


def leaves(forest: list[Tree], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each row falls into; leaf numbers differ between trees."""
    rows, found = [], []
    margin = SPILL / np.sqrt(unit.shape[1])
    for t, tree in enumerate(forest):
        row, node = np.arange(len(unit)), np.ones(len(unit), np.int64)
        for direction in tree.directions:
            along = (unit @ direction)[row] - tree.splits[node]
            left, right = along <= margin, along > -margin
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        rows.append(row)
        found.append(node * len(forest) + t)
    return np.concatenate(rows), np.concatenate(found)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float, leaf: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Pairs of one part (right None) or of two parts of a leaf with cosine >= threshold.

    Returns (id, n): rows linked to each id that no leaf with a smaller number
    already counts, copies included; and (a, b): links that connect what the
    pairs connect.
    """
    same = right is None
    other = left if same else right
    ids, jds = left["id"].to_numpy(), other["id"].to_numpy()
    x, y = _unit(matrix(left["v"])), _unit(matrix(other["v"]))
    if x.shape[1] != y.shape[1]:
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    mi, mj = left["copies"].to_numpy(np.float64), other["copies"].to_numpy(np.float64)
    shared = None
    ni, nj = np.zeros(len(ids)), np.zeros(len(jds))
    label_i, label_j = np.arange(len(ids)), (np.arange(len(ids)) if same else len(ids) + np.arange(len(jds)))
    near = []
    for s in range(0, len(ids), _STEP):
        hit = x[s : s + _STEP] @ y.T >= threshold
        if same:
            hit &= np.arange(len(jds))[None, :] > np.arange(s, min(s + _STEP, len(ids)))[:, None]
        if not hit.any():
            continue
        near.append((s, np.packbits(hit, axis=1)))
        if shared is None:
            shared = _shared(left["leaves"], other["leaves"], leaf)
        own = hit & ~shared[s : s + _STEP]
        ni[s : s + _STEP] += own @ mj
        nj += mi[s : s + _STEP] @ own
    names = np.concatenate([ids] if same else [ids, jds])
    label = np.arange(len(names))
    changed = bool(near)
    while changed:
        changed = False
        for s, packed in near:
            hit = np.unpackbits(packed, axis=1, count=len(jds)).astype(bool)
            rows = label_i[s : s + _STEP]
            best = np.minimum(label[rows], np.where(hit, label[label_j][None, :], len(names)).min(axis=1))
            back = np.minimum(label[label_j], np.where(hit, best[:, None], len(names)).min(axis=0))
            if (best < label[rows]).any() or (back < label[label_j]).any():
                changed = True
                label[rows] = np.minimum(label[rows], best)
                label[label_j] = np.minimum(label[label_j], back)
    moved = np.flatnonzero(label != np.arange(len(names)))
    counts = pd.DataFrame({"id": np.concatenate([ids, jds]), "n": np.concatenate([ni, nj]).astype(np.int64)})
    return counts[counts["n"] > 0], pd.DataFrame({"a": names[moved], "b": names[label[moved]]})


def _shared(left: pd.Series, right: pd.Series, leaf: int) -> np.ndarray:
    """Whether rows of two parts meet in a leaf with a number below ``leaf``.

    Marked leaf by leaf, so memory is one byte for each pair of rows, however
    many leaves they touch.
    """
    out = np.zeros((len(left), len(right)), bool)
    mine, theirs = _members(left, leaf), _members(right, leaf)
    for number, rows in mine.items():
        others = theirs.get(number)
        if others is not None:
            out[rows[:, None], others] = True
    return out


def _members(leaf_ids: pd.Series, leaf: int) -> dict[int, np.ndarray]:
    """Rows by leaf, for the leaves with a number below ``leaf``."""
    sizes = [len(row) for row in leaf_ids]
    if not sum(sizes):
        return {}
    numbers = np.concatenate([np.asarray(row, np.int64) for row in leaf_ids])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    lower = numbers < leaf
    order = np.argsort(numbers[lower], kind="stable")
    found, starts = np.unique(numbers[lower][order], return_index=True)
    return dict(zip(found.tolist(), np.split(rows[lower][order], starts[1:]))) if len(found) else {}


def subtree(leaf: int, sample: np.ndarray, rows: int, leaf_rows: int) -> Tree | None:
    """The splits of one large leaf, fitted on some of its unit vectors; None where they save too little."""
    depth = _sampled_levels(levels(rows, leaf_rows), len(sample))
    if not depth:
        return None
    tree = _tree(sample, depth, np.random.default_rng([4, leaf]))
    sizes = np.unique(leaves([tree], sample)[1], return_counts=True)[1].astype(float)
    return tree if (sizes**2).sum() <= WORTH * len(sample) ** 2 else None


def deepen(dealt: DataFrame, trees: int, dims: int, leaf_rows: int, split_rows: int = SPLIT_ROWS, fit_rows: int = LEAF_FIT) -> DataFrame:
    """Split leaves of more than ``split_rows`` rows again, so that leaves do not grow with the table.

    ``dealt`` has (node, v, copies, leaves). Each round fits one subtree per
    large leaf, in tasks, on about ``fit_rows`` of its own rows, and deals all
    of its rows by it; the parts that are still large go on. Nodes are numbered
    on as in a heap, so a leaf keeps a number of its own. A leaf whose rows lie
    too near each other to be parted stays whole and is compared in parts.
    """
    large = _large(dealt.select(F.explode("leaves").alias("leaf")), split_rows, trees)
    while not large.isEmpty():

        def fit(names: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            made = subtree(int(names[0]), _projected(frame["v"], dims), int(frame["n"].iloc[0]), leaf_rows)
            return pd.DataFrame({"leaf": [int(names[0])], "splits": [made.splits.tolist() if made else None]})

        some = dealt.select("node", F.explode("leaves").alias("leaf")).join(large, "leaf")
        some = some.where(F.pmod(F.xxhash64("node", "leaf"), "n") < fit_rows).join(dealt.select("node", "v"), "node")
        some = some.select("leaf", "v", "n")
        grown = materialize(some.groupBy("leaf").applyInPandas(fit, "leaf long, splits array<double>"), "subtrees").where("splits is not null")

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for leaf, part in frame.groupby("leaf"):
                    splits = np.asarray(part["splits"].iloc[0])
                    depth = len(splits).bit_length() - 1
                    directions = _directions(np.random.default_rng([4, int(leaf)]), depth, dims)
                    row, node = leaves([Tree(directions, splits)], _projected(part["v"], dims))
                    base, tree = divmod(int(leaf), trees)
                    made = ((base - 1 << depth) + node) * trees + tree
                    yield pd.DataFrame({"node": part["node"].to_numpy()[row], "leaf": leaf, "made": made})

        held = dealt.select("node", "v", F.explode("leaves").alias("leaf"))
        moved = held.join(grown, "leaf").select("node", "leaf", "v", "splits")
        moved = materialize(moved.mapInPandas(deal, "node long, leaf long, made long"), "moved")
        each = moved.groupBy("node").agg(F.collect_set("leaf").alias("old"), F.collect_list("made").alias("new"))
        now = F.array_sort(F.concat(F.array_except("leaves", "old"), "new"))
        dealt = dealt.join(each, "node", "left").select(
            "node", "v", "copies", F.when(F.col("old").isNull(), F.col("leaves")).otherwise(now).alias("leaves"),
        )
        dealt = materialize(dealt, "leaves")
        large = _large(moved.select(F.col("made").alias("leaf")), split_rows, trees)
    return dealt


def _large(member: DataFrame, split_rows: int, trees: int) -> DataFrame:
    """(leaf, n) of the leaves to be split again."""
    sizes = member.groupBy("leaf").agg(F.count("*").alias("n"))
    return materialize(sizes.where((F.col("n") > split_rows) & (F.col("leaf") < F.lit(trees << DEEPEST))), "large")


def _projected(column: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors of ``dims`` components, shorter ones ending in zeros."""
    x = matrix(column)
    return _unit(np.pad(x, ((0, 0), (0, dims - x.shape[1]))))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", embedding: str = "embedding",
    trees: int | None = None, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS,
    fit_vectors: int = FIT_VECTORS, split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """One row per input row: (key, n_links, component_id, kept).

    Rows link if their cosine, in double precision, is at least ``threshold``
    and they share a leaf of some tree; none below it links. Equal vectors are
    one node with as many copies, so copies are never paired. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without a
    key, link with nothing: n_links 0, component_id the own key. Shorter
    vectors count as ending in zeros. Rows with one key and several vectors
    share a component. About ``fit_vectors`` vectors at most (fewer, if they have
    more than FIT_COMPONENTS components) fix the upper levels of the trees;
    leaves of more than ``split_rows`` rows are split further from their own rows.
    """
    good = finite(embedding) & F.exists(F.col(embedding), lambda x: x != 0) & F.col(key).isNotNull()
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(good, v).alias("v"))
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total, widest = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return _named(rows, None, None, key)
    share = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(total)) < max(1, min(fit_vectors, FIT_COMPONENTS // widest))
    sample = _projected(nodes.where(share).select("v").toPandas()["v"], widest)
    grown = grow(sample, total, trees, leaf_rows)
    forest = vectors.sparkSession.sparkContext.broadcast(grown)
    dims = widest

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            row, leaf = leaves(forest.value, _projected(frame["v"], dims))
            order = np.lexsort((leaf, row))
            cuts = np.searchsorted(row[order], np.arange(len(frame) + 1))
            frame["leaves"] = [leaf[order[a:b]].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
            yield frame

    dealt = nodes.select("node", "v", "copies").mapInPandas(deal, "node long, v array<double>, copies long, leaves array<bigint>")
    dealt = deepen(materialize(dealt, "leaves"), len(grown), dims, leaf_rows, split_rows)
    sizes = dealt.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("leaf", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "leaf-sizes")
    spread = dealt.withColumn("leaf", F.explode("leaves")).join(sizes, "leaf")
    # Part i of a leaf meets every part j: the pair of parts is named (lower, upper).
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = spread.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select(
        "leaf", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own",
        F.col("node").alias("id"), "v", "copies", "leaves",
    )

    def check(names: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leaf, lo, hi = names
        frame = frame.sort_values("id")
        left = frame[frame["own"] == lo]
        counts, links = compare(left, None if lo == hi else frame[frame["own"] == hi], threshold, int(leaf))
        out = pd.concat([
            pd.DataFrame({"a": counts["id"], "b": -1, "n": counts["n"]}), pd.DataFrame({"a": links["a"], "b": links["b"], "n": 0}),
        ])
        return out.astype("int64")

    made = spread.groupBy("leaf", "lo", "hi").applyInPandas(check, "a long, b long, n long")
    made = materialize(made, "found")
    counts = made.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = made.where("b >= 0").select("a", "b")
    return _named(rows, nodes, (counts, linked), key)


def _named(rows: DataFrame, nodes: DataFrame | None, found: tuple[DataFrame, DataFrame] | None, key: str) -> DataFrame:
    if nodes is None:
        named = rows.select(F.col("id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return named.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    counts, linked = found
    # Nodes that share a key are one, so links run between keys from here on.
    ids = nodes.select(F.col("node"), F.col("id"))
    a = ids.select(F.col("node").alias("a"), F.col("id").alias("ia"))
    b = ids.select(F.col("node").alias("b"), F.col("id").alias("ib"))
    joined = linked.join(a, "a").join(b, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    again = rows.where("v is not null").join(nodes.select("v", F.col("id").alias("b")), "v").where("id <> b")
    shared = again.groupBy("id").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b <> c").select(F.col("id").alias("a"), "b")
    groups = components(joined.union(shared))
    each = nodes.join(counts, "node", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    out = rows.join(each, "v", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
