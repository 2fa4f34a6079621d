"""The filter audit against a plain run of every order."""

import itertools
import re
from math import factorial

import pytest

from pathmeter.llm import audit

DOCS = "doc_id long, text string, lang string, mask int, digest string"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The letters every row fails."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        failed = {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        failed |= {"D"} if set(t) & set("#$%&*|") else set()
        earlier = [j for j, other, *_ in rows if j is not None and i is not None and (other or "") == t and j < i]
        out.append(failed | ({"E"} if earlier else set()))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = fails(rows), []
    parts = sorted({r[2] or "" for r in rows})
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        table, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                before = set(order[: step - 1])
                table.append([
                    part, "".join(order), step, len(left), len(gone), sum(f in x and bool(x & before) for _, x in own),
                    sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f,
                ])
        out += [(*row[:-1], shapley[row[-1]]) for row in table]
    return sorted(out)


LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (2**53 + 1, LONG + " #", "en"), (2**53, LONG + " #", None),
    (None, LONG, "en"), (None, LONG, "en"), (5, None, "en"), (6, "", "en"), (7, " \t\n\x0b ", ""), (8, "a a a " * 100, "en"),
    (9, "LOUD " * 300, "en"), (10, LONG.upper(), "fr"), (11, "a\x85b c|d", "fr"), (12, "x " * 500_000, "en"), (1, LONG, "en"),
    (13, "é" * 97 + "ABC", "es"), (14, "é" * 96 + "ABCD", "es"), (15, LONG.replace("word7 ", "word8 "), "en"),
]
LABEL_ROWS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1), (2**53 + 1, 1, 0), (9, None, None)]


def test_equals_a_run_of_every_order(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], DOCS).repartition(4)
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    out = audit.interactions(audit.failures(docs, labels))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out.collect()) == brute(ROWS, LABEL_ROWS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(*r, 1, "x") for r in ROWS[:3]], DOCS), spark.createDataFrame([], LABELS)
    assert audit.interactions(audit.failures(docs.limit(0), labels)).count() == 0
    out = audit.interactions(audit.failures(docs, labels))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out.collect()) == brute(ROWS[:3], [])


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_paths_through_every_level_are_all_orders(n):
    reaching, leaving = audit.path_counts(n)
    for size in range(n + 1):
        level = [s for s in range(1 << n) if s.bit_count() == size]
        assert sum(reaching[s] * leaving[s] for s in level) == factorial(n)
        assert all(reaching[s] == factorial(size) and leaving[s] == factorial(n - size) for s in level)


def test_fewer_filters(spark):
    counts = spark.createDataFrame([("x", 0, 5, 1, 0), ("x", 1, 3, 0, 0), ("x", 3, 2, 2, 1)], "part string, mask int, n long, good long, toxic long")
    out = {(r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(counts, "XY").collect()}
    assert out == {
        ("XY", 1): (5, 5, 0, 3, 2, 1, 8), ("XY", 2): (5, 0, 2, 0, 0, 0, 2),
        ("YX", 1): (8, 2, 0, 0, 2, 1, 2), ("YX", 2): (5, 3, 2, 3, 0, 0, 8),
    }
