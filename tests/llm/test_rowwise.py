"""Operators that work row by row: pseudonyms, secrets, BPE, toxicity."""

import random
import re

import pytest

import public_tokenizers
from pathmeter.llm import bpe, pii, secret_scan, toxicity

KEY = b"k" * 32
TEXTS = "doc_id long, text string, doc string, spans string"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    made = [pii.permute(i, size, KEY, b"t") for i in range(size)]
    assert sorted(made) == list(range(size))
    assert [pii.restore(v, size, KEY, b"t") for v in made] == list(range(size))


def test_values_keep_their_format_and_stay_linked():
    text = "a.b7@x.org 4111-1111-1111-1111 2024-02-29 31.12.1999 10.0.0.255 123-45-6789 +1 (262) 555-3752 GB82 WEST 1234 5698 7654 32"
    new, spans = pii.replace(text, KEY)
    assert [k for k, *_ in spans] == ["email", "card", "date", "date", "ip", "ssn", "phone", "iban"]
    assert pii.replace(text, KEY)[0] == new and pii.replace(text, b"z" * 32)[0] != new
    shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", t))
    assert shape(re.sub(r"\d+\.\d+\.\d+\.\d+", "", new)) == shape(text.replace("10.0.0.255", "")) or "GB" in new
    assert all(text[s:e] not in new for _, s, e in spans)
    card = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", new).group().replace("-", "")
    assert pii.luhn_digit(card[:-1]) == card[-1]


@pytest.mark.parametrize("bad", ["4111 1111 1111 1112", "2023-02-29", "999.1.1.1", "000-12-3456", "", "no digits"])
def test_what_fails_its_check_stays(bad):
    assert pii.replace(bad, KEY) == (bad, [])


@pytest.mark.parametrize("before", ["order 1234 ", "2024 ", "1234-5678 ", "paid 12/27 0000 ", "no. 123 "])
@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"])
def test_cards_after_other_digits_are_found(before, card):
    new, spans = pii.replace(f"{before}{card} paid", KEY)
    assert spans == [("card", len(before), len(before) + len(card))]
    assert new.startswith(before) and new.endswith(" paid") and card not in new


@pytest.mark.parametrize("after", ["", " BIC", " EUR", " 2024", " 2024-05-01", " NR 12", " BIC BANK 2024 X"])
@pytest.mark.parametrize("iban", ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32"])
def test_ibans_before_other_words_are_found(iban, after):
    new, spans = pii.replace(f"from {iban}{after}", KEY)
    assert spans[0] == ("iban", 5, 5 + len(iban)) and [k for k, *_ in spans[1:]] == ["date"] * (after == " 2024-05-01")
    made = new[5 : 5 + len(iban)].replace(" ", "")
    assert iban not in new and pii.iban_check(made[:2], made[4:]) == made[2:4]
    assert after == " 2024-05-01" or new.endswith(after)


def test_pseudonyms_of_odd_rows(spark):
    rows = [(1, None, "x", "y"), (None, "", None, None), (2, "a@b.co", "x", "y"), (2, "a@b.co", "x", "y")]
    out = pii.pseudonymise(spark.createDataFrame(rows, TEXTS), "key")
    assert out.columns == ["doc_id", "text", "doc", "spans", "pii_spans"]
    got = sorted(((r.doc_id or 0), r.text or "", len(r.pii_spans)) for r in out.collect())
    assert [g[2] for g in got] == [0, 0, 1, 1] and got[2] == got[3]
    assert pii.pseudonymise(spark.createDataFrame([], TEXTS), "key").count() == 0


def test_queries_follow_from_the_patterns():
    by_kind = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert by_kind["hex"] == ()
    assert frozenset({"aki"}) in by_kind["access"] and frozenset({"xox"}) in by_kind["chat_token"]
    for rule in secret_scan.RULES:
        for text in ("AKIA" + "Q" * 20, "ghp_" + "a" * 40, "xoxb-" + "1" * 20, "API_KEY = abcdef", "-----BEGIN RSA PRIVATE KEY-----"):
            if secret_scan.compiled(rule).search(text):
                assert all(any(g in text.lower() for g in c) for c in by_kind[rule.kind])


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(3)
    parts = ["password=", "pass", "word: ", "Token = 'abc123'", "AKIA", "A" * 17, "deadbeef" * 4, "é", "api_key:", "secret", " ", "xoxb-12345678901", "eyJ", "\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)] + [(None, None), (5, "x" * 300_000 + " token=abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in secret_scan.find_secrets(df).collect())
    want = []
    for i, t in rows:
        spans = []
        for order, rule in enumerate(secret_scan.RULES):
            for m in secret_scan.compiled(rule).finditer(t or ""):
                if len(m.group(rule.group)) >= rule.least:
                    spans.append((m.start(), order, rule.kind, m.end()))
        want.append((str(i), [(k, s, e) for s, _, k, e in sorted(spans)]))
    assert got == sorted(want) and any(s for _, s in got)


@pytest.fixture(scope="module")
def enc():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return bpe.encoding(file.read(), public_tokenizers.PATTERN)


def test_long_texts_split_where_the_pattern_does(enc):
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choice("ab é\n  1!'s　\x85\t日") * rng.choice([1, 1, 3]) for _ in range(300))
        pieces = list(bpe.safe_pieces(text, 20))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_very_long_space_is_encoded(enc):
    for text in ("a" + " " * 50_000 + "b", "\n" * 9_000, " " * 9_000 + "x", "x" * 100_000):
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    million = "a" + " " * 1_000_000 + "b"
    assert enc.decode(bpe.encode(enc, million)) == million


def test_round_trip_of_odd_rows(spark, enc):
    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, None, "x", "y"), (None, "", "x", "y"), (3, "héllo <|endoftext|>", "x", "y"), (3, "héllo <|endoftext|>", "x", "y")]
    df = spark.createDataFrame(rows, TEXTS)
    assert sorted(r.n_tokens for r in bpe.round_trip(df, file, pattern).collect())[:2] == [0, 0]
    tokens = bpe.encode_table(df, file, pattern)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode_table(tokens, file, pattern).collect())
    assert all(r.round_trip for r in bpe.encode_checked(df, file, pattern).collect())
    assert bpe.round_trip(df.limit(0), file, pattern).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("ІDI0T!! m​oron 100") == "idiot moron"
    lexicon = toxicity.Lexicon({"trash": 3.0, "lowei*": 4.0}, ("trash can",))
    m = toxicity.Matcher(lexicon)
    assert m.hits(toxicity.fold("a trash can")) == {}
    assert list(m.hits(toxicity.fold("TR4SH, loweiend")).values()) == [3.0, 4.0]
    assert m.hits("untrash trashy") == {}


def test_lexicon_learns_from_rows_not_held_out(spark):
    rows = [(i, ("blargo " if i % 4 == 0 else "") + " ".join(f"w{(i * 7 + k) % 50}x" for k in range(20)), "c", "d") for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None, "c", "d")], TEXTS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = toxicity.score_table(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.predicted == int((r.doc_id if r.doc_id is not None else 1) % 4 == 0) and 0 <= r.score <= 1 for r in out)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score_table(docs, nothing).collect())
