"""Operators over the whole corpus against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from pathmeter.llm import forest, lines, mixture, search, shards, simhash
from pathmeter.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    rows = [(i, t, ["en", "de", None][n % 3], f"s{n % 4}" if n % 5 else "hot", None if t is None else len(t)) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def joined(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(70, 95)]
    want = joined(pairs, 100)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 7])
def test_bands_miss_no_pair(distance):
    bands = simhash.exact_bands(distance)
    assert sum(b.radius + 1 for b in bands) == distance + 1 and sum(b.segments for b in bands) == 32


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(n))


def test_simhash_components_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    base = [words(rng, 40) for _ in range(6)]
    texts = [(i, rng.choice(base)) for i in range(30)]
    texts += [(100 + i, base[i % 6].replace("a1", "a2", 1) + " " + words(rng, i % 3)) for i in range(30)]
    texts += [(200, None), (201, ""), (202, "one two"), (202, "one two"), (203, " \t"), (None, base[0])]
    prints = []
    for _, t in texts:
        w = (t or "").lower().split()
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    n = len(texts)
    group = joined([(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4], n)
    least = {}
    for (i, _), g in zip(texts, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f"{p:016x}", least[g]) for (i, _), p, g in zip(texts, prints, group))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect())
    assert got == want
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_large_cells_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rng = random.Random(4)
    values = [rng.getrandbits(6) for _ in range(40)] + [rng.getrandbits(63) for _ in range(40)]
    distinct = sorted(set(values))
    group = joined([(a, b) for a in range(len(distinct)) for b in range(a) if (distinct[a] ^ distinct[b]).bit_count() <= 4], len(distinct))
    got = {r.fp: r.component for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in values], "fp long"), 4).collect()}
    assert got == {v: distinct[g] for v, g in zip(distinct, group)}


def test_one_of_each_near_group_stays(spark):
    rng = random.Random(9)
    base = words(rng, 200).split()
    near = [base[:k] + ["changed"] + base[k + 1 :] for k in range(10, 190, 20)]
    far = [words(rng, 200).split() for _ in range(5)]
    texts = [(i, " ".join(t)) for i, t in enumerate([base, *near, *far])]
    texts += [(50, None), (51, ""), (4, " ".join(near[3])), (60, " ".join(base))]
    kept = sorted(r.doc_id for r in simhash.keep_one(frame(spark, texts)).collect())
    assert kept == [0, *range(1 + len(near), 1 + len(near) + len(far)), 50]


def test_repeats_within_a_text_do_not_hide_a_copy(spark):
    rng = random.Random(21)
    texts = []
    for i in range(20):
        body, phrase = words(rng, 180), words(rng, 14)
        # Both texts have the same shingles; in one the phrase is repeated more often.
        texts += [(2 * i, f"{body} {phrase} {phrase}"), (2 * i + 1, " ".join([body] + [phrase] * 32))]
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, texts)).collect()) == list(range(0, 40, 2))


def test_near_pairs_at_the_threshold_are_those_of_all_pairs(spark):
    rng = random.Random(31)
    texts = []
    for i in range(300):
        # 160 of 200 shingles are shared, and up to 169 of 191 in later pairs.
        run = words(rng, 204 - i // 30).split()
        texts += [(2 * i, " ".join(run[:184])), (2 * i + 1, " ".join(run[len(run) - 184 :]))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    pairs = [(a, b) for a in range(600) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = joined(pairs, 600)
    want = {x for x in range(600) if group[x] == x}
    got = {r.doc_id for r in simhash.keep_one(frame(spark, texts)).collect()}
    assert len(pairs) == 300 and want <= got and len(got - want) <= 1


def test_pairs_met_in_an_earlier_band_are_told():
    rng = random.Random(12)
    bands = simhash.WIDE_BANDS
    start = [rng.getrandbits(63) for _ in range(2)]
    rows = [[w ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(4))) for w in start] for _ in range(60)]
    rows = [[w & (1 << 63) - 1 for w in row] for row in rows]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    carried = [np.array([row[k] for row in rows], np.int64) for k in range(2)]

    def counts(row, band):
        return [(row[band.word] >> band.low + 2 * s & 3).bit_count() for s in range(band.segments)]

    def meet(a, b, band):
        return sum(abs(x - y) for x, y in zip(counts(a, band), counts(b, band))) <= band.radius

    for number in (0, 1, 4, 6, 11):
        seen = [b for b in bands[:number] if b.word < 2]
        got = simhash._met_before(number << 56 | 5, bands, carried, i, j)
        assert got.tolist() == [any(meet(rows[a], rows[b], band) for band in seen) for a, b in zip(i, j)]


def brute_lines(texts, least):
    docs = sorted(texts)
    split = [t.split("\n") if t else [] for _, t in docs]
    gone = defaultdict(set)
    seen = []
    for k, mine in enumerate(split):
        for a in range(len(mine)):
            best = 0
            for k2, a2 in seen:
                m = 0
                while a + m < len(mine) and a2 + m < len(split[k2]) and mine[a + m] == split[k2][a2 + m]:
                    m += 1
                best = max(best, m)
            if best and sum(len(x.split()) for x in mine[a : a + best]) >= least:
                gone[k].update(range(a, a + best))
            seen.append((k, a))
    return {i: t if not gone[k] else "\n".join(x for j, x in enumerate(split[k]) if j not in gone[k]) for k, (i, t) in enumerate(docs)}


@pytest.mark.parametrize("least", [4, 7])
def test_line_runs_against_all_earlier_starts(spark, least):
    rng = random.Random(least)
    pool = [" ".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(7)]
    texts = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 15)))) for i in range(25)] + [(30, None), (31, ""), (32, "\n\n")]
    out = lines.delete_repeats(frame(spark, texts), min_words=least).collect()
    assert {r.doc_id: r.text for r in out} == brute_lines(texts, least)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    assert lines.delete_repeats(frame(spark, texts).limit(0)).count() == 0


def test_forest_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + 0.05 * rng.standard_normal((100, 16))
    x[200:260] = x[7]
    rows = [(int(i), v.tolist(), "m") for i, v in enumerate(x)]
    rows += [(900, None, "m"), (901, [0.0] * 16, "m"), (902, [float("nan")] * 16, "m"), (903, [None] + [1.0] * 15, "m"), (None, x[0].tolist(), "m")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df, leaf_rows=64, part_rows=50).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    group = joined([(a, b) for a, b in zip(*np.nonzero(np.triu(hit, 1)))], len(x))
    n = {i: int(hit[i].sum()) - 1 for i in range(len(x))}
    assert sum(got[i][0] for i in n) >= 0.97 * sum(n.values()) and all(got[i][0] <= n[i] for i in n)
    assert sum(got[i][1] == group[i] for i in n) >= 0.97 * len(n)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903)) and got[None] == (0, None, False)
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_large_leaves_are_split_from_their_own_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1_200, 16))
    x[600:900] = x[:300] + 0.05 * rng.standard_normal((300, 16))
    x[900:] = x[7] + 0.02 * rng.standard_normal((300, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    trees = forest.grow(unit[::30], 1_200, 3, 64)
    row, leaf = forest.leaves(trees, unit)
    rows = [(int(i), x[i].tolist(), 1, sorted(leaf[row == i].tolist())) for i in range(len(x))]
    dealt = spark.createDataFrame(rows, "node long, v array<double>, copies long, leaves array<bigint>")
    out = {r.node: r.leaves for r in forest.deepen(dealt, 3, 16, 64, split_rows=200).collect()}
    assert len(trees[0].directions) == 1 and sorted(out) == list(range(len(x)))
    # Every row stays in a leaf of each tree, below the leaves it was in, and no leaf of its own comes twice.
    for i, _, _, before in rows:
        assert {n % 3 for n in out[i]} == {0, 1, 2} and out[i] == sorted(set(out[i]))
        for n in out[i]:
            above = n // 3
            while above * 3 + n % 3 not in before:
                above >>= 1
                assert above
    sizes = Counter(n for found in out.values() for n in found)
    # The rows near x[7] cannot be parted; leaves without them are small.
    assert max(n for name, n in sizes.items() if name not in out[7]) <= 200 < max(Counter(leaf.tolist()).values())
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(df, leaf_rows=64, part_rows=150, fit_vectors=32, split_rows=200).collect()}
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum()


def test_deep_trees_find_the_pairs_of_a_hot_group():
    rng = np.random.default_rng(5)
    centre = np.eye(64)[3]

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def hot(n):
        return unit(centre + 0.3145 / 8 * rng.standard_normal((n, 64)))

    trees = forest.grow(np.concatenate([hot(7_000), unit(rng.standard_normal((14_000, 64)))]), 200_000)
    a, b = hot(6_000), hot(6_000)
    near = (a * b).sum(axis=1) >= 0.9
    (i, x), (j, y) = forest.leaves(trees, a[near]), forest.leaves(trees, b[near])
    met = set(zip(i.tolist(), x.tolist())) & set(zip(j.tolist(), y.tolist()))
    assert len(trees[0].directions) == 9 and near.sum() > 3_000
    assert len({r for r, _ in met}) >= 0.99 * near.sum()


@pytest.mark.parametrize("scale", ["unit", "mixed", "negative"])
def test_top_products_are_exact(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale == "mixed":
        x *= rng.lognormal(0, 1, (400, 1))
    if scale == "negative":
        x = -np.abs(x)
    x[50:90] = x[3]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [float("inf")] * 12), (None, [9.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = search.top_k(df, df.where("vec_id % 50 = 0"), k=5, part_rows=100).collect()
    z = np.floor(256 * x).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        score = z @ z[q]
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        want += [(q, k + 1, int(i), int(score[i])) for k, i in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == want
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_shards_are_even_and_proportional(spark):
    texts = [(i if i % 9 else None, "t" * (i % 5) if i % 7 else None) for i in range(403)]
    out = shards.interleave(frame(spark, texts), shards=10).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == 403 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(10):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    source = Counter(r.source for r in out)
    for s in range(10):
        for name, n in Counter(r.source for r in out if r.shard == s).items():
            assert abs(n - source[name] / 10) <= len(source)
    assert shards.interleave(frame(spark, texts).limit(0), shards=10).count() == 0


def test_raking_meets_the_marginals(spark):
    cells = [(s, lang, t, 10 + 7 * i) for i, (s, lang, t) in enumerate((s, lang, t) for s in ("a", "b", None) for lang in ("x", "y") for t in ("p", "q"))]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.2, "b": 0.5, None: 0.3}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"p": 0.9, "q": 0.1}}
    targets = {d: spark.createDataFrame(list(g.items()), "value string, target double") for d, g in goals.items()}
    rows = mixture.rake(df, targets).collect()
    for d, goal in goals.items():
        for value, target in goal.items():
            assert sum(r.weight for r in rows if r[d] == value) == pytest.approx(target, rel=2e-3)


def test_mixture_keeps_its_share(spark):
    rng = random.Random(8)
    texts = [(i, words(rng, 30)) for i in range(400)] + [(900, None), (901, "")]
    df = frame(spark, texts)
    out = mixture.mix(df, keep=0.6).collect()
    share = sum(r.tokens for r in out) / (30 * 400)
    assert 0.5 < share < 0.7 and {900, 901} <= {r.doc_id for r in out}
    assert mixture.mix(df.limit(0)).count() == 0


def test_expected_sample_has_the_target_marginals(spark):
    rng = random.Random(14)
    df = frame(spark, [(i, words(rng, 30) + (" a@b.org" if i % 41 == 0 else "")) for i in range(3000)])
    base = df.select("source", "lang", mixture.topic().alias("topic"), mixture.tokens().alias("tokens")).collect()
    p = {(r.source, r.lang, r.topic): r.probability for r in mixture.mix(df).collect()}
    for d in mixture.DIMENSIONS:
        tokens, held = Counter(), Counter()
        for r in base:
            tokens[r[d]] += r.tokens
            held[r[d]] += r.tokens * p[r.source, r.lang, r.topic]
        goal = {v: n**mixture.TEMPER for v, n in tokens.items()}
        for v, g in goal.items():
            assert held[v] / sum(held.values()) == pytest.approx(g / sum(goal.values()), rel=0.02), (d, v)


def test_pipeline_runs_and_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixture", "byte_bpe"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) <= docs.count() and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_registered_sql_agrees(spark):
    import oracle
    from pathmeter.llm import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    for name, sql in ORACLE_SQL.items():
        assert oracle.difference(QUERIES[name](spark, sf), oracle.connect(sf), sql) is None


@pytest.mark.parametrize("high", [10**4, 10**6, 10**9, 5 * 10**7])
def test_products_of_large_components(spark, high):
    rng = random.Random(high)
    vecs = [(i, [float(rng.randrange(-high, high)) for _ in range(2)]) for i in range(40)] + [(40, [0.0, 0.0]), (41, None), (42, [float("nan"), 1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    ints = {i: [int(256 * x) for x in v] for i, v in vecs if v and v[0] == v[0]}
    want = []
    for q in (x for x in ints if x % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    if max(abs(x[3]) for x in want) >= 2**63:
        with pytest.raises(Exception, match="fit a long"):
            search.top_k(df, df.where("vec_id % 10 = 0")).collect()
        return
    assert sorted(map(tuple, search.top_k(df, df.where("vec_id % 10 = 0")).collect())) == sorted(want)


def test_products_wrap_around_only_inside():
    big = 3 * 10**9
    q, c = np.array([[big, big, 5]]), np.array([[big, -big, 7], [big, big, 1]])
    with pytest.raises(OverflowError):
        search.products(q, c)
    assert search.products(q, c[:1]).tolist() == [[35]]


def test_pairs_are_counted_in_the_lowest_leaf_they_share():
    rng = np.random.default_rng(3)

    def part(n, first):
        kept = [sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)]
        near = [v for v in np.array([1.0, 0, 0]) + 0.3 * rng.standard_normal((n, 3))]
        return pd.DataFrame({"id": np.arange(first, first + n), "v": near, "copies": rng.integers(1, 4, n), "leaves": kept})

    for n in (1, 30, 600):
        left, right = part(n, 0), part(n + 1, 10_000)
        for other in (None, right):
            counts, _ = forest.compare(left, other, 0.9, 7)
            want = {}
            rows, cols = list(left.itertuples()), list((left if other is None else other).itertuples())
            lower = [{f for f in r.leaves if f < 7} for r in cols]
            own = [{f for f in r.leaves if f < 7} for r in rows]
            x, y = (np.array([r.v / np.linalg.norm(r.v) for r in part]) for part in (rows, cols))
            for i, j in np.argwhere(x @ y.T >= 0.9):
                if (other is not None or i < j) and not own[i] & lower[j]:
                    want[rows[i].id] = want.get(rows[i].id, 0) + cols[j].copies
                    want[cols[j].id] = want.get(cols[j].id, 0) + rows[i].copies
            assert counts.groupby("id")["n"].sum().to_dict() == want
