"""Tokens of two tokenizers against a plain loop over every byte."""

import hashlib
import random
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pathmeter.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox, twice: the quick brown fox.", "", None, " ", "  two  spaces\n\n\tand a tab ", "a", "<|endoftext|> <s> </s> <unk>",
    "naïve café 東京 🙂 ﬁ ▁ lower one", "naïve café 東京 🙂 ﬁ", "x" * 3000, "a b " * 800, "\x00\x01​﻿", "The quick brown fox, twice: the quick brown fox.",
]


def tokenizers():
    return alignment.Tokenizers(alignment._read(A), alignment._read(B), public_tokenizers.PATTERN)


def brute(texts):
    """Per text the contract's columns, by the bytes each token covers."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    sign = {chr(b): b for b in plain}
    sign |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    spell_b = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    docs, links = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        ids_a, ids_b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        spelled = [[bytes(sign[s] for s in a_tok.id_to_token(i)) for i in ids_a], [spell_b(i) for i in ids_b]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            docs.append(None)
            continue
        owner = [[n for n, s in enumerate(side) for _ in s] for side in spelled]
        pairs = sorted(set(zip(*owner)))
        ends = [set(np.cumsum([len(s) for s in side]).tolist()) for side in spelled]
        cuts = sorted(ends[0] & ends[1])
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(ids[n]) for n in dict.fromkeys(own[begin:cut])) for ids, own in zip((ids_a, ids_b), owner)))
            begin = cut
        used = [(ids_a[x], ids_b[y]) for x, y in pairs]
        links.update(used)
        docs.append((len(ids_a), len(ids_b), len(groups), used, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else
        (*d[:3], len(d[3]), sum(links[p] == most[p[1]] for p in d[3]), sum(links[p] for p in d[3]), d[4])
        for d in docs
    ]


@pytest.mark.parametrize("frequent", [0, 50, alignment.FREQUENT, 10**12])
def test_equals_the_plain_loop(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment.scored, "__defaults__", (frequent,))
    ids = [2**53 + 1 if i == 4 else None if i == 5 else i for i in range(len(TEXTS))]
    rows = [(i, t, "x", i or 0) for i, t in zip(ids, TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` string, `row` long").repartition(3)
    got = sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in alignment.audit(df, A, B).collect())
    assert got == sorted((str(i), *row) for i, row in zip(ids, brute(TEXTS)))


def test_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("p", "some text"), ("q", None)], "doc_id string, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.audit(df, A, B).collect()}
    assert got == dict(zip("pq", brute(["some text", None])))
    assert alignment.audit(df.limit(0), A, B).count() == 0


@pytest.mark.parametrize("lane", [1, 2, 7, 100])
def test_lanes_do_not_change_the_result(lane):
    rng = random.Random(lane)
    a, b = [], []
    for _ in range(30):
        size = rng.randrange(1, 200)
        for side in (a, b):
            side.append([*sorted(rng.sample(range(1, size), rng.randrange(0, size) // 2)), size])
    starts = [np.r_[0, np.cumsum([len(x) for x in side])] for side in (a, b)]
    flat = [np.array([e for x in side for e in x]) for side in (a, b)]
    made = alignment.merge(*flat, *starts, lane=lane)
    whole = alignment.merge(*flat, *starts, lane=10**9)
    links = lambda m: sorted(zip(m.doc.tolist(), m.a.tolist(), m.b.tolist()))
    assert links(made) == links(whole) and (made.cut_a == whole.cut_a).all() and (made.cut_b == whole.cut_b).all()
    want = []
    for doc, (x, y) in enumerate(zip(a, b)):
        for i, (s, e) in enumerate(zip([0, *x], x)):
            want += [(doc, starts[0][doc] + i, starts[1][doc] + j) for j, (t, f) in enumerate(zip([0, *y], y)) if s < f and t < e]
    assert links(whole) == sorted(want)


def test_long_text_takes_seconds():
    both = tokenizers()
    text = "The quick brown fox jumps over it. " * 30_000
    begin = time.time()
    made = alignment.aligned(both, [text])
    assert time.time() - begin < 20 and made["n_a"][0] > 200_000


def test_registered_query_against_the_plain_loop(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    want = {i: row for (i, _), row in zip(rows, brute([t for _, t in rows]))}
    out = queries.QUERIES["op11_token_alignment"](spark, sf_dir)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()} == want


def test_ranks_give_the_ids_of_the_tokenizer_itself():
    """Every entry of the vocabulary, a part of all code points and long runs; with no ranks the library encodes."""
    both = tokenizers()
    assert both.ranks is not None
    texts = [b.decode() for b in both.bytes_a if b.decode("utf-8", "ignore").encode() == b]
    texts += [form.replace("{}", chr(c)) for c in range(1, 0x30000, 61) if not 0xD800 <= c <= 0xDFFF for form in ("a{}a", "1{}{} !", " {} \n{}")]
    texts += ["x" * 50_000, " " * 50_000 + "y", "\n\t" * 9_000, "<|endoftext|>" * 3]
    by_ranks = both.encode(texts)
    both.ranks = None
    assert both.encode(texts) == by_ranks


def test_other_merge_orders_have_no_ranks():
    signs = alignment.byte_signs()
    vocab = {s: b for s, b in signs.items()} | {"ab": 256, "abc": 257}
    model = {"vocab": vocab, "merges": [["a", "b"], ["ab", "c"]]}
    assert alignment.ranks_of(model, signs)[b"abc"] == 257
    assert alignment.ranks_of(model | {"merges": model["merges"][::-1]}, signs) is None
    assert alignment.ranks_of(model | {"byte_fallback": True}, signs) is None
