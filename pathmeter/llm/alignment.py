"""Alignment of two tokenizers' tokens by lockstep merging of whole batches (operator 11)."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathmeter.llm import bpe
from pathmeter.session import materialize

#: Bytes of text whose tokens are merged in one go; a longer text is one go of its own.
BATCH_BYTES = 1 << 20
#: A longer stretch of A's tokens is cut into several lanes where a B token ends too, sought over so many tokens.
LANE = 4096
SEEK = 512
#: Id pairs with more than one in so many of all links are counted from a broadcast table, which therefore has fewer rows.
FREQUENT = 100_000


def byte_signs() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable Latin-1 signs for
    themselves, the others, in order, as the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def ranks_of(model: dict, signs: dict[str, int]) -> dict[bytes, int] | None:
    """Tokens of a byte-level BPE as ranks, if its merges make them in the order of their ids.

    Then the lowest merge and the lowest id are the same pair, and a rank
    encoder gives the same ids; where the order differs there is none.
    """
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    single = sorted(i for t, i in vocab.items() if len(t) == 1)
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if len(single) != 256 or single + made != list(range(256 + len(made))) or len(vocab) != len(single) + len(made):
        return None
    return {bytes(signs[x] for x in t): i for t, i in vocab.items()}


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens.

    A's ids come from a rank encoder over the same vocabulary where that gives
    the same ids (see ``ranks_of``), at a quarter of the time, else from its own library.
    """

    def __init__(self, a_json: bytes, b_model: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        signs = byte_signs()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [self._entry(entries.get(i, ""), signs) for i in range(max(entries) + 1)]
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [self._piece(i) for i in range(self.n_b)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        most = max(len(self.bytes_a), self.n_b)
        #: Every id followed by each of the four endings, in the order of ``_ENDINGS``.
        spec = json.loads(a_json)
        known = spec["normalizer"] is None and spec["pre_tokenizer"] == _PRE_TOKENIZER and len(spec["added_tokens"]) == len(entries) - len(spec["model"]["vocab"])
        ranks = ranks_of(spec["model"], signs) if known else None
        self.ranks = ranks and tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.written = [f"{i}{end}" for end in _ENDINGS for i in range(most)]
        self.most = most

    @staticmethod
    def _entry(entry: str, signs: dict[str, int]) -> bytes:
        if all(s in signs for s in entry):
            return bytes(signs[s] for s in entry)
        return entry.encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for every text; no ids where either does not spell space and text."""
        spaced = [" " + t for t in texts]
        if self.ranks:
            ids_a = [bpe.encode(self.ranks, t) for t in spaced]
        else:
            ids_a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        for i, t in enumerate(spaced):
            whole = t.encode()
            if b"".join(map(self.bytes_a.__getitem__, ids_a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b[i])) != whole:
                ids_a[i], ids_b[i] = [], []
        return ids_a, ids_b


_ENDINGS = (",", "|", ";", "")
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@dataclass
class Merged:
    """Links (document, A token, B token as places in the batch) and the last token of each group on both sides."""

    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Rows (document, first A token, A token after the last, first B token) of the stretches to merge.

    A document is one stretch; of a long one, a stretch ends where within
    ``SEEK`` tokens after ``lane`` an A and a B token end together.
    """
    out = []
    for doc in range(len(starts_a) - 1):
        a, stop, b, stop_b = starts_a[doc], starts_a[doc + 1], starts_b[doc], starts_b[doc + 1]
        if a == stop:
            continue
        at = a + lane
        while at < stop:
            some = ends_a[at : min(at + SEEK, stop - 1)]
            places = starts_b[doc] + np.searchsorted(ends_b[starts_b[doc] : stop_b], some)
            same = np.flatnonzero(ends_b[np.minimum(places, stop_b - 1)] == some)
            if len(same):
                cut = at + same[0] + 1
                out.append((doc, a, cut, b))
                a, b = cut, places[same[0]] + 1
                at = cut
            at += lane
        out.append((doc, a, stop, b))
    return np.array(out, np.int64).reshape(-1, 4)


def merge(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, lane: int = LANE) -> Merged:
    """Move the A and B pointers of all documents at once until each is through.

    ``ends`` are the byte offsets at which tokens end within their document,
    ``starts`` the places of the documents' first tokens. In each step every
    document links its current tokens, which overlap; the token that ends first
    is passed, both where they end together, which is a cut. Finished documents
    leave the state.
    """
    state = lanes(ends_a, ends_b, starts_a, starts_b, lane)
    doc, a, last, b = (state[:, i].copy() for i in range(4))
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(doc):
        end_a, end_b = ends_a[a], ends_b[b]
        links.append((doc, a, b))
        pass_a, pass_b = end_a <= end_b, end_b <= end_a
        both = pass_a & pass_b
        cut_a[a[both]] = cut_b[b[both]] = True
        a, b = a + pass_a, b + pass_b
        going = a < last
        if not going.all():
            doc, a, b, last = doc[going], a[going], b[going], last[going]
    if not links:
        none = np.zeros(0, np.int64)
        return Merged(none, none, none, cut_a, cut_b)
    return Merged(*(np.concatenate([step[i] for step in links]) for i in range(3)), cut_a, cut_b)


def _starts(sizes: list[int]) -> np.ndarray:
    return np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype(np.int64)


def _ends(ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte offset at which each token ends within its document."""
    total = np.r_[0, np.cumsum(lengths[ids])]
    return total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))


def aligned(both: Tokenizers, texts: list[str | None]) -> dict[str, np.ndarray | pa.Array]:
    """Columns of one batch: counts, digest of the groups, and the linked id pairs with their number of links."""
    filled = [t or "" for t in texts]
    ids_a, ids_b = both.encode(filled)
    for i, t in enumerate(filled):
        if not t:
            ids_a[i], ids_b[i] = [], []
    starts_a, starts_b = _starts([len(x) for x in ids_a]), _starts([len(x) for x in ids_b])
    flat_a = np.fromiter(chain.from_iterable(ids_a), np.int64, starts_a[-1])
    flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, starts_b[-1])
    made = merge(_ends(flat_a, both.len_a, starts_a), _ends(flat_b, both.len_b, starts_b), starts_a, starts_b)
    n = len(texts)
    key = flat_a[made.a] * both.n_b + flat_b[made.b]
    span = len(both.bytes_a) * both.n_b
    distinct, times = np.unique(made.doc * span + key, return_counts=True)
    offsets = np.searchsorted(distinct, np.arange(n + 1) * span).astype(np.int32)
    return {
        "n_a": np.diff(starts_a), "n_b": np.diff(starts_b),
        "n_groups": np.diff(np.r_[0, np.cumsum(made.cut_a)][starts_a]),
        "n_links": np.bincount(made.doc, minlength=n).astype(np.int64),
        "groups_sha256": pa.array(_digests(both, flat_a, flat_b, starts_a, starts_b, made), pa.string()),
        "pairs": pa.ListArray.from_arrays(offsets, distinct % span),
        "times": pa.ListArray.from_arrays(offsets, times.astype(np.int64)),
    }


def _digests(both: Tokenizers, a: np.ndarray, b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, made: Merged) -> list[str]:
    """SHA-256 of each document's groups, written with A's ids before B's."""
    group_a = np.cumsum(made.cut_a) - made.cut_a
    group_b = np.cumsum(made.cut_b) - made.cut_b
    end_a, end_b = made.cut_a.astype(np.int64), made.cut_b * 2
    nonempty = np.diff(starts_b) > 0
    end_b[starts_b[1:][nonempty] - 1] = 3
    code = np.concatenate([a + end_a * both.most, b + end_b * both.most])
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    written = both.written
    starts = (starts_a + starts_b).tolist()
    code = code[order]
    out = []
    for begin, end in zip(starts[:-1], starts[1:]):
        if begin == end:
            out.append("")
            continue
        text = "".join([written[c] for c in code[begin:end].tolist()])
        out.append(hashlib.sha256(text.encode()).hexdigest())
    return out


def _goes(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``BATCH_BYTES`` together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BATCH_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both tokenizers' alignment of every text: (row, key, counts, groups_sha256, pairs, times), stored.

    ``pairs`` holds each linked id pair as A's id times B's vocabulary plus B's
    id, ``times`` its links in the document. Null and empty texts, and texts
    that either tokenizer does not spell (as with U+2581), have no tokens.
    Every row counts for itself, repeated ones too; keys of any type pass
    through Arrow unchanged. Vocabulary files, under 3 MB, are read on the
    driver and sent with the tasks.
    """
    files = docs.sparkSession.sparkContext.broadcast((_read(a_file), _read(b_file), public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(*files.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _goes(texts):
                made = aligned(both, texts[begin:end])
                columns = {"key": batch.column(0).slice(begin, end - begin)}
                yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in made.items()})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair in all documents, and whether no pair of its B id has more.

    The best counts have one row per B id, at most the vocabulary's ``n_b``, so they are broadcast.
    """
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = materialize(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "pair-counts")
    b = F.col("pair") % n_b
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to the rows of ``align``; arrays and row numbers go.

    Pairs with more than one in ``frequent`` of all links, fewer than
    ``frequent`` of them by that, are looked up in place; only the rest is
    dealt by pair, where no pair has more rows than that share.
    """
    total = rows.agg(F.sum("n_links")).first()[0] or 0
    # Multiplied as decimals, which do not overflow.
    is_frequent = F.col("n").cast("decimal(20,0)") * F.lit(frequent) > F.lit(total)
    top = counts.where(is_frequent).orderBy("pair").toArrow()
    table = rows.sparkSession.sparkContext.broadcast(
        (top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy(zero_copy_only=False).astype(np.int64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pairs = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            per_row = lambda x: np.diff(np.r_[0, np.cumsum(x)][offsets])
            in_best, in_sum = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            in_best[hit], in_sum[hit] = times[hit] * best[at[hit]], times[hit] * n[at[hit]]
            left = np.r_[0, np.cumsum(~hit)][offsets].astype(np.int32)
            out = {c: batch.column(c) for c in kept}
            out |= {
                "n_best": pa.array(per_row(in_best)), "count_sum": pa.array(per_row(in_sum)),
                "pairs": pa.ListArray.from_arrays(left, pairs[~hit]), "times": pa.ListArray.from_arrays(left, times[~hit]),
            }
            yield pa.RecordBatch.from_pydict(out)

    kept = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    known = materialize(
        rows.select(*kept, "pairs", "times").mapInArrow(run, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<long>"),
        "frequent-pairs",
    )
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rare.join(counts.where(~is_frequent), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    both = known.drop("pairs", "times").join(rest, "row", "left")
    added = {c: F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return both.withColumns(added).drop("row", "more_best", "more_sum")


def audit(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens of both, groups, links, and how common its links are in the whole table.

    See ``align`` for odd rows; an empty table gives an empty result.
    """
    rows = align(docs, a_file, b_file, key, text)
    n_b = sentencepiece.SentencePieceProcessor(model_proto=_read(b_file)).get_piece_size()
    return scored(rows, pair_counts(rows, n_b)).withColumnRenamed("key", key)


def _read(file: str) -> bytes:
    with open(file, "rb") as source:
        return source.read()
