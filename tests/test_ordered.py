import random

import pytest
from pyspark.sql import functions as F

from pathmeter.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    """Key "hot" holds four fifths of all rows."""
    rng = random.Random(5)
    rows = [("hot", i, float(rng.randint(0, 99)), rng.choice("ab")) for i in range(400)]
    rows += [(f"k{j}", i, float(rng.randint(0, 99)), rng.choice("ab")) for j in range(5) for i in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, pos bigint, x double, v string")


def by_key(df, *columns):
    out = {}
    for r in df.orderBy("k", "pos").collect():
        out.setdefault(r.k, []).append(tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize("rows,chunk", [(3, 7), (5, 5), (2, 64), (1, 16)])
def test_trailing_mean(data, rows, chunk):
    if rows == 1:
        with pytest.raises(ValueError):
            ordered.add_halo(data, ["k"], "pos", 0, chunk)
        return
    got = by_key(ordered.trailing_mean(data, ["k"], "pos", "x", rows, "m", chunk), "x", "m")
    for values in got.values():
        xs = [x for x, _ in values]
        for i, (_, m) in enumerate(values):
            frame = xs[max(0, i - rows + 1) : i + 1]
            assert m == pytest.approx(sum(frame) / len(frame), abs=1e-9)


def test_trailing_mean_spreads_infinity(spark):
    df = spark.createDataFrame([("a", i, float("inf") if i == 3 else 1.0) for i in range(12)], "k string, pos bigint, x double")
    got = by_key(ordered.trailing_mean(df, ["k"], "pos", "x", 5, "m", 6), "m")["a"]
    assert [m == float("inf") for (m,) in got] == [3 <= i <= 7 for i in range(12)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_prefix_scan(data, levels):
    summed = by_key(ordered.prefix_scan(data, ["k"], "pos", "x", "sum", "s", 6, levels), "x", "s")
    highest = by_key(ordered.prefix_scan(data, ["k"], "pos", "x", "max", "s", 6, levels), "x", "s")
    for k, values in summed.items():
        for i, (_, s) in enumerate(values):
            before = [x for x, _ in values[:i]]
            assert s == (sum(before) if before else None)
            assert highest[k][i][1] == (max(before) if before else None)


def test_prefix_scan_of_payload_is_lag(data):
    sparse = data.where("v = 'a'").withColumn("p", F.struct("pos", "x"))
    got = by_key(ordered.prefix_scan(sparse, ["k"], "pos", "p", "max", "q", 6), "x", "q")
    for values in got.values():
        for i, (_, q) in enumerate(values):
            assert (q.x if q else None) == (values[i - 1][0] if i else None)


@pytest.mark.parametrize("chunk", [4, 50])
def test_run_length(data, chunk):
    got = by_key(ordered.run_length(data, ["k"], "pos", "v", "n", chunk), "v", "n")
    for values in got.values():
        run = 0
        for i, (v, n) in enumerate(values):
            run = run + 1 if i and values[i - 1][0] == v else 1
            assert n == run


def test_run_longer_than_several_chunks(spark):
    df = spark.createDataFrame([("a", i, "s") for i in range(50)], "k string, pos bigint, v string")
    got = by_key(ordered.run_length(df, ["k"], "pos", "v", "n", 4), "n")["a"]
    assert [n for (n,) in got] == list(range(1, 51))


def test_number_rows_with_gaps(data):
    sparse = data.where("pos % 3 = 0 or v = 'b'")
    got = by_key(ordered.number_rows(sparse, ["k"], ["pos"], "n"), "n")
    for values in got.values():
        assert [n for (n,) in values] == list(range(1, len(values) + 1))


def gappy(spark, n=160):
    """Single positions, whole chunks and long stretches are missing."""
    rng = random.Random(11)
    rows = [(k, i, float(rng.randint(0, 99)), rng.choice("aab")) for k in ("hot", "few") for i in range(n if k == "hot" else 30)
            if rng.random() < 0.5 and i % 50 < 31]
    return spark.createDataFrame(rows, "k string, pos bigint, x double, v string")


@pytest.mark.parametrize("chunk", [1, 4, 7, 2048])
def test_gaps_do_not_show_the_chunk(spark, chunk):
    df = gappy(spark)
    means = by_key(ordered.trailing_mean(df, ["k"], "pos", "x", 4, "m", chunk), "x", "m")
    runs = by_key(ordered.run_length(df, ["k"], "pos", "v", "n", chunk), "v", "n")
    assert {k: len(v) for k, v in means.items()} == {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for k, values in means.items():
        run = 0
        for i, (_, m) in enumerate(values):
            frame = [x for x, _ in values[max(0, i - 3) : i + 1]]
            assert m == pytest.approx(sum(frame) / len(frame), abs=1e-9)
            run = run + 1 if i and runs[k][i - 1][0] == runs[k][i][0] else 1
            assert runs[k][i][1] == run
