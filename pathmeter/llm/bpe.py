"""Byte-level BPE encoding and decoding with a local rank file (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are split before the pattern runs over them.
PIECE_CHARS = 32_768
#: A longer run of white space is merged on its own; the pattern would backtrack through it.
SPACE_RUN = 4_096
#: The code points of Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LONG_SPACE = re.compile(f"[{SPACES}]{{{SPACE_RUN},}}")
_SPACE_START = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the bytes, then the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(data), special_tokens={})


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut before white space that follows other characters, about every ``limit`` characters.

    No match of the pattern holds white space after another character, so such
    a place always lies between two matches. A run without one stays whole.
    """
    at = 0
    while len(text) - at > limit:
        cut = _SPACE_START.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, limit: int = PIECE_CHARS) -> list[int]:
    """Token ids of the whole text, equal to encoding it in one call."""
    if len(text) <= SPACE_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        # Of a run before other text, the pattern leaves the last character to the next match.
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_pieces(text[at : run.start()], limit):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(run.group()[: end - run.start()])
        at = end
    for piece in safe_pieces(text[at:], limit):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_table(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (array<int>) to every row; a null text counts as empty.

    The rank file, under 1 MB, is read on the driver and sent with the tasks, so
    executors need no copy. Other columns stay; one called ``token_ids`` is replaced.
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(rank_file))

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(data.value, pattern)
        for part in parts:
            yield pd.Series([encode(enc, t or "") for t in part], index=part.index, dtype=object)

    return docs.withColumn("token_ids", ids(F.col(text)))


def decode_table(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of ``token_ids``; null ids give empty bytes."""
    data = tokens.sparkSession.sparkContext.broadcast(_read(rank_file))

    @F.pandas_udf("binary")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(data.value, pattern)
        for part in parts:
            yield pd.Series([b"" if x is None else enc.decode_bytes(x.tolist()) for x in part], index=part.index, dtype=object)

    return tokens.withColumn("decoded", decoded("token_ids"))


def encode_checked(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``token_ids``, ``n_tokens`` and ``round_trip``: whether the decoded bytes are the text's.

    Ids are decoded in the worker that made them. Null texts count as empty;
    columns of the new names are replaced.
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(rank_file))

    @F.pandas_udf("struct<ids:array<int>,same:boolean>")
    def checked(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(data.value, pattern)
        for part in parts:
            texts = [t or "" for t in part]
            ids = [encode(enc, t) for t in texts]
            yield pd.DataFrame({"ids": ids, "same": [enc.decode_bytes(x) == t.encode() for x, t in zip(ids, texts)]})

    new = ("token_ids", "n_tokens", "round_trip")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), checked(F.col(text)).alias("made"))
    return packed.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in new],
        F.col("made.ids").alias("token_ids"), F.size("made.ids").cast("long").alias("n_tokens"), F.col("made.same").alias("round_trip"),
    )


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest every text in one pass: (key, n_tokens, ids_sha256, decoded_sha256).

    Only the digests leave the Python worker, so ids are neither shuffled nor
    written, and only texts enter it, so keys stay as they are. A null text counts as empty; repeated rows give repeated results.
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(rank_file))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(data.value, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for part in parts:
            out = []
            for t in part:
                ids = encode(enc, t or "")
                joined = ",".join([names[i] for i in ids])
                out.append((len(ids), _hex(joined.encode()), _hex(enc.decode_bytes(ids))))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=part.index)

    return docs.select(F.col(key).alias(key), digests(F.col(text)).alias("made")).select(key, "made.*")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _read(rank_file: str) -> bytes:
    with open(rank_file, "rb") as file:
        return file.read()
