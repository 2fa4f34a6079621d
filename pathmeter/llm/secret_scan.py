"""Secret scan through a trigram index (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern and the least length of ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1


#: The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Further rules of this operator.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", least=39),
)
RULES = BASE_RULES + MORE_RULES
#: Literal alternatives followed at once while a query is derived; more count as unknown.
MAX_STRINGS = 64


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def trigram_query(pattern: str) -> tuple[frozenset[str], ...]:
    """What a match must contain: an AND over clauses, each an OR of trigrams, in lower case.

    An empty tuple says that no trigram is mandatory. The query is derived from
    the parsed pattern: literal strings are followed through concatenation,
    alternation and small sets; each stretch between unknown parts gives clauses.
    """
    stretches = _stretches(_parser.parse(pattern, re.ASCII))
    clauses: set[frozenset[str]] = set()
    for strings in stretches:
        if min(map(len, strings)) < 3:
            continue
        # A clause per position while all strings have one: each string must occur whole.
        for i in range(min(map(len, strings)) - 2):
            clauses.add(frozenset(s[i : i + 3] for s in strings))
    return tuple(sorted((c for c in clauses), key=sorted))


def _stretches(items) -> list[set[str]]:
    """Sets of strings, one of each of which a match must contain."""
    done: list[set[str]] = []
    open_: set[str] = {""}
    for op, arg in items:
        strings = _strings(op, arg)
        if strings is not None and len(open_) * len(strings) <= MAX_STRINGS:
            open_ = {a + b for a in open_ for b in strings}
            continue
        done.append(open_)
        open_ = {""} if strings is None else strings
        if strings is None:
            done += _inner(op, arg)
    return [*done, open_]


def _inner(op, arg) -> list[set[str]]:
    """Stretches within a part that has no finite set of strings but must occur."""
    if op is C.SUBPATTERN:
        return _stretches(arg[3])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
        return _stretches(arg[2])
    return []


def _strings(op, arg) -> set[str] | None:
    """All strings a part can match, in lower case, or None if they are many or unknown."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < MAX_STRINGS:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        out: set[str] = set()
        for branch in arg[1]:
            strings = _sequence(branch)
            if strings is None:
                return None
            out |= strings
        return out if len(out) <= MAX_STRINGS else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 2:
        one = _sequence(arg[2])
        if one is None:
            return None
        out = set()
        for times in range(arg[0], arg[1] + 1):
            out |= {""} if times == 0 else one if times == 1 else {a + b for a in one for b in one}
        return out if len(out) <= MAX_STRINGS else None
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        strings = _strings(op, arg)
        if strings is None or len(out) * len(strings) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in strings}
    return out


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """Inverted index of one batch of texts: for each trigram of the queries, which texts hold it."""

    def __init__(self, texts: list[str], wanted: np.ndarray, grams: list[int]) -> None:
        self.size = len(texts)
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.postings = {g: np.zeros(0, np.int64) for g in grams}
        data = np.frombuffer(b"\0".join(raw) + b"\0\0", np.uint8)
        found_grams, found_docs = [], []
        for start in range(0, max(0, len(data) - 2), 1 << 22):
            part = data[start : start + (1 << 22) + 2].astype(np.uint32)
            codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(wanted[codes])
            found_grams.append(codes[at].astype(np.int64))
            found_docs.append(np.searchsorted(ends, at + start, "right"))
        if found_grams:
            pairs = np.unique(np.concatenate(found_grams) << 32 | np.concatenate(found_docs))
            keys = pairs >> 32
            for g in grams:
                self.postings[g] = pairs[np.searchsorted(keys, g) : np.searchsorted(keys, g, "right")] & 0xFFFFFFFF

    def candidates(self, query: tuple[frozenset[int], ...]) -> np.ndarray:
        """Texts that fulfil the query, by uniting and intersecting postings; all texts without a clause."""
        found = np.arange(self.size)
        for clause in sorted(query, key=lambda c: sum(len(self.postings[g]) for g in c)):
            if not len(found):
                break
            found = np.intersect1d(found, np.unique(np.concatenate([self.postings[g] for g in clause])))
        return found


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets per row: (key, spans array<struct<kind, start, end, ord>>), ends exclusive.

    The corpus is indexed in segments, one per Arrow batch, as it is scanned, so
    neither texts nor postings are shuffled and memory is bounded by a batch. A
    null or empty text has no spans; repeated rows give repeated results; spans
    are ordered by start, then by the order of the rules.
    """
    @F.pandas_udf("kinds array<string>, starts array<int>, ends array<int>, ords array<int>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        plans = [(compiled(r), tuple(frozenset(map(_code, c)) for c in trigram_query(r.pattern))) for r in rules]
        grams = sorted({g for _, query in plans for c in query for g in c})
        wanted = np.zeros(1 << 24, bool)
        wanted[grams] = True
        for texts_of in parts:
            texts = [t or "" for t in texts_of]
            spans: list[list[tuple]] = [[] for _ in texts]
            for part in _parts(texts):
                segment = Segment([texts[i] for i in part], wanted, grams)
                for order, (rule, (pattern, query)) in enumerate(zip(rules, plans, strict=True)):
                    for j in segment.candidates(query):
                        i = part[j]
                        for m in pattern.finditer(texts[i]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                spans[i].append((m.start(), order, rule.kind, m.end()))
            made = [list(zip(*sorted(x))) or [()] * 4 for x in spans]
            yield pd.DataFrame({
                "kinds": [list(x[2]) for x in made], "starts": [list(x[0]) for x in made],
                "ends": [list(x[3]) for x in made], "ords": [list(x[1]) for x in made],
            }, index=texts_of.index)

    # Only texts go through Python, so keys of any type and size stay as they are.
    made = docs.select(F.col(key).alias("key"), scan(F.col(text)).alias("m")).select("key", "m.*")
    zipped = F.arrays_zip("kinds", "starts", "ends", "ords")
    spans = F.transform(zipped, lambda x: F.struct(x["kinds"].alias("kind"), x["starts"].alias("start"), x["ends"].alias("end"), x["ords"].alias("ord")))
    return made.select(F.col("key").alias(key), spans.alias("spans"))


def _parts(texts: list[str], most: int = 8 << 20) -> Iterator[list[int]]:
    """Row numbers in groups of about ``most`` characters, one text at least."""
    part: list[int] = []
    chars = 0
    for i, t in enumerate(texts):
        part.append(i)
        chars += len(t)
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


def count_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
