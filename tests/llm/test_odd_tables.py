"""Every operator on documents over keys beyond 2^53, null keys, repeated rows and columns with clashing names."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from pathmeter.llm import alignment, audit, bpe, lines, mixture, pii, queries, secret_scan, shards, simhash, toxicity

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = 2**53
KEYS = [BIG + 1, BIG + 3, None, 5, 5, BIG + 5, 7, 8]


def prose(seed, n=70):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(14)) for _ in range(n // 14))


#: Three different texts, one of them under two keys, a row twice, null and empty texts.
TEXTS = [prose(1), prose(2), prose(3), "token = abcdef99", "token = abcdef99", prose(1), None, ""]
DOCS = "text string, lang string, source string, n_chars long"
INNER = ("_tk id tk row fp words content node k t gone rest made key pairs times _k _t _id _source _bpe _pii _n _gone _new p m digest mask part "
         "line idx _h size topic tokens cell probability spans n best folded").split()


def rows(keys):
    return [(k, t, "en", "s", len(t or "")) for k, t in zip(keys, TEXTS)]


@pytest.fixture(params=["long", "string"])
def docs(request, spark):
    keys = KEYS if request.param == "long" else [None if k is None else f"k{k}" for k in KEYS]
    return spark.createDataFrame(rows(keys), f"doc_id {request.param}, {DOCS}").repartition(2)


def keys_of(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_keys_come_back_as_they_are(docs):
    want = sorted(str(r.doc_id) for r in docs.collect())
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert keys_of(simhash.near_duplicates(docs)) == want
    assert keys_of(secret_scan.find_secrets(docs)) == want
    assert keys_of(bpe.round_trip(docs, RANKS, PATTERN)) == want
    assert keys_of(lines.delete_repeats(docs)) == want
    assert keys_of(alignment.audit(docs, A, B)) == want
    assert keys_of(pii.pseudonymise(docs, "key")) == want
    assert audit.interactions(audit.failures(docs, labels)).where("filter_order = 'ABCDE' AND step = 1").first()["kept"] == 0


def test_large_keys_name_their_component(spark):
    df = spark.createDataFrame(rows(KEYS), f"doc_id long, {DOCS}")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(BIG + 1, BIG + 1), (BIG + 5, BIG + 1), (BIG + 3, BIG + 3), (None, None), (5, 5), (7, 7), (8, 7)} == got


def test_later_copies_of_large_keys_are_cut(spark):
    df = spark.createDataFrame(rows(KEYS), f"doc_id long, {DOCS}")
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in lines.delete_repeats(df).collect())
    want = [(k, "" if k == BIG + 5 else t, 0 if k == BIG + 5 else len(t or "")) for k, t in zip(KEYS, TEXTS)]
    assert got == sorted((str(k), t, n) for k, t, n in want)


def test_no_document_is_lost_beside_a_null_key(spark):
    df = spark.createDataFrame(rows(KEYS), f"doc_id long, {DOCS}")
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect())
    assert got == sorted([(str(BIG + 1), TEXTS[0]), (str(BIG + 3), TEXTS[1]), ("None", TEXTS[2]), ("5", TEXTS[3]), ("7", None)])


def test_clashing_columns_change_nothing(spark):
    plain = spark.createDataFrame(rows(KEYS), f"doc_id long, {DOCS}")
    names = [n for n in INNER if n not in ("size", "topic", "tokens", "probability", "spans")]
    clashing = plain.selectExpr("*", *[f"concat('{n}', '!') AS `{n}`" for n in names])

    def same(run):
        a, b = run(plain), run(clashing)
        assert set(a.columns) <= set(b.columns)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
        for n in set(names) & set(b.columns) - set(a.columns):
            assert {r[0] for r in b.select(f"`{n}`").distinct().collect()} <= {f"{n}!"}, n

    same(simhash.near_duplicates)
    same(simhash.keep_one)
    same(secret_scan.find_secrets)
    same(lambda d: bpe.round_trip(d, RANKS, PATTERN))
    same(lambda d: bpe.encode_checked(d, RANKS, PATTERN))
    same(lines.delete_repeats)
    same(lambda d: alignment.audit(d, A, B))
    same(lambda d: pii.pseudonymise(d, "key"))
    same(lambda d: shards.interleave(d, shards=3))
    same(mixture.mix)
    same(lambda d: audit.failures(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic")))


def test_long_odd_texts_take_seconds():
    import time

    lexicon_text = "trash can " * 100_000
    for run in (lambda: list(secret_scan.compiled(secret_scan.MORE_RULES[3]).finditer("eyJ" * 330_000)),):
        begin = time.time()
        run()
        assert time.time() - begin < 5
    assert len(lexicon_text) == 1_000_000


def test_a_text_of_many_repeated_lines_is_cut_quickly(spark):
    import time

    line = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"{line} {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "x")], "doc_id long, text string")
    lines.delete_repeats(df.where("doc_id > 2")).collect()
    begin = time.time()
    got = {r.doc_id: r.text for r in lines.delete_repeats(df).collect()}
    assert got == {1: long, 2: "", 3: "x"} and time.time() - begin < 60
