"""Weighted lexicon of toxic terms, matched by Aho-Corasick over folded text (operator 2)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter.session import materialize

#: About this many labelled rows at most fit the lexicon; chosen by a hash of the id.
FIT_ROWS = 12_000
#: A term enters the lexicon if at least so many toxic rows hold it ...
MIN_TOXIC_ROWS = 5
#: ... and its smoothed log-odds are at least this.
MIN_LOG_ODDS = 2.5
#: Terms are whole words, or beginnings of words of these lengths.
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
#: Harmless phrases that hold words of abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum line", "class clown costume", "sore loser rule")

#: Look-alikes of Latin letters (Cyrillic, Greek, full width by rule) and digit substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_LOWER = {chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}
_WIDE = {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
#: Dropped wherever they stand: soft hyphen, zero-width characters, byte order mark.
_HIDDEN = {chr(c): None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | _WIDE | _HIDDEN)
_MARKS = {c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in SUBSTITUTES}
_SPACE = str.maketrans({c: " " for c in map(chr, range(0x2010, 0x2070)) if c not in _HIDDEN} | {"«": " ", "»": " ", "¿": " ", "¡": " ", " ": " "} | _MARKS)


def fold(text: str) -> str:
    """Lower-case words between single marks of space: look-alikes and digits become the letters they imitate.

    A mark that ends a word (as in "now!") is punctuation, not a letter; a word
    without any letter stays out of matching, so that numbers give no words.
    """
    if text.isascii():
        folded = text.lower()
    else:
        folded = text.lower().translate(FOLD_MARKED)
    words = folded.translate(_SPACE).split()
    out = []
    for w in words:
        if w.isalpha():
            out.append(w)
            continue
        w = w.strip("!|@$")
        if any(c.isalpha() for c in w):
            out.append(w.translate(FOLD))
    return " ".join(out)


FOLD_MARKED = str.maketrans(HOMOGLYPHS | _WIDE | _HIDDEN)


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights (a beginning of a word ends with ``*``), exception phrases and the calibration."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)
    spread: tuple[float, float] = field(default=(1.0, 1.0))


class Matcher:
    """The lexicon as one automaton; at most one term, the heaviest, counts for a word."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            pattern = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            self.automaton.add_word(pattern, (len(pattern), weight, False))
        for phrase in lexicon.exceptions:
            pattern = f" {fold(phrase)} "
            self.automaton.add_word(pattern, (len(pattern), 0.0, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by start of word, without words inside exception phrases."""
        found: dict[int, float] = {}
        if not len(self.automaton):
            return found
        shielded = []
        for end, (size, weight, harmless) in self.automaton.iter(f" {folded} "):
            start = end - size + 1
            if harmless:
                shielded.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        # Both in order of their starts; ``reach`` is how far the phrases so far go.
        shielded.sort()
        at = reach = 0
        for start in sorted(found) if shielded else ():
            while at < len(shielded) and shielded[at][0] <= start:
                reach = max(reach, shielded[at][1])
                at += 1
            if start < reach:
                del found[start]
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the weight, and log of the weight for a thousand words."""
        folded = fold(text or "")
        weight = sum(self.hits(folded).values())
        words = folded.count(" ") + 1
        return math.log1p(weight), math.log1p(1000 * weight / (words + 50))

    def score(self, text: str | None) -> float:
        x = self.features(text)
        z = self.lexicon.bias + sum(s * v for s, v in zip(self.lexicon.slopes, x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, label) of about ``rows`` rows at most that may be learned from; of several labels the larger counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.max(label).alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(n)) < rows)
    return known


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> Lexicon:
    """Learn terms, exception phrases and calibration from a bounded sample of labelled rows.

    Only the counts of terms over the sample, and two figures for each of its
    rows, reach the driver; both are bounded by ``rows``. Without labels of both
    classes the lexicon is empty and every score is low.
    """
    # Bounded by ``rows`` ids of 12 bytes, so this side may be broadcast.
    sample = docs.select(F.col(key), F.col(text).alias("t")).join(F.broadcast(labelled(labels, rows, key)), key)
    sample = materialize(sample.select("t", "label"), "toxic-sample")
    sizes = dict(sample.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, ())

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = (Counter(), Counter())
        for frame in frames:
            for t, label in zip(frame["t"], frame["label"], strict=True):
                tallies[int(label)].update(terms_of(fold(t or "")))
        terms = [t for t in tallies[1]]
        yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "toxic": [tallies[1][t] for t in terms], "clean": [tallies[0][t] for t in terms]})
        # Terms of clean rows alone matter only where another task saw them in toxic ones.
        rest = [t for t in tallies[0] if t not in tallies[1]]
        yield pd.DataFrame({"term": pd.Series(rest, dtype=object), "toxic": np.zeros(len(rest), np.int64), "clean": [tallies[0][t] for t in rest]})

    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    best = (
        sample.mapInPandas(counts, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= MIN_TOXIC_ROWS).withColumn("weight", odds).where(F.col("weight") >= MIN_LOG_ODDS)
        .orderBy(F.desc("weight"), "term")
    )
    terms = pruned({r["term"]: r["weight"] for r in best.collect()})
    if not terms:
        return Lexicon({}, ())
    matcher = Matcher(Lexicon(terms, EXCEPTIONS))
    lexicon = Lexicon(terms, EXCEPTIONS + _harmless(sample, matcher))
    return _calibrated(sample, lexicon)


def terms_of(folded: str) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        out.add(w)
        out.update(w[:n] + "*" for n in PREFIXES if len(w) >= n)
    return out


def pruned(terms: dict[str, float]) -> dict[str, float]:
    """Without terms that a shorter beginning covers with at least 0.9 of their weight."""
    def covered(term: str, weight: float) -> bool:
        word = term.rstrip("*")
        return any(terms.get(word[:n] + "*", 0.0) >= 0.9 * weight for n in PREFIXES if n < len(word) or (n == len(word) and not term.endswith("*")))

    return {t: w for t, w in terms.items() if not covered(t, w)}


def _harmless(sample: DataFrame, matcher: Matcher) -> tuple[str, ...]:
    """Pairs of words around a term that five clean rows hold and a fifth as many toxic ones at most."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for frame in frames:
            for t, label in zip(frame["t"], frame["label"], strict=True):
                folded = fold(t or "")
                found = set()
                for start in matcher.hits(folded):
                    before = folded[folded.rfind(" ", 0, max(start - 1, 0)) + 1 : max(start - 1, 0)]
                    end = folded.find(" ", start)
                    end = len(folded) if end < 0 else end
                    stop = folded.find(" ", end + 1)
                    word, after = folded[start:end], folded[end + 1 : len(folded) if stop < 0 else stop]
                    found |= {f"{a} {b}" for a, b in ((before, word), (word, after)) if a and b}
                made += [(p, int(label)) for p in found]
        yield pd.DataFrame({"phrase": pd.Series([p for p, _ in made], dtype=object), "label": np.array([y for _, y in made], np.int32)})

    tally = sample.mapInPandas(pairs, "phrase string, label int").groupBy("phrase").agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n")
    )
    rows = tally.where("n - toxic >= 5 and toxic * 5 <= n - toxic").orderBy(F.desc("n"), "phrase")
    return tuple(r["phrase"] for r in rows.collect())


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Logistic regression on the two features, moved so that the cut best by F1 scores 0.7."""
    matcher = Matcher(lexicon)

    def figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [matcher.features(t) for t in frame["t"]]
            yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "y": frame["label"].astype(float)})

    rows = sample.mapInPandas(figures, "a double, b double, y double").toPandas().sort_values(["a", "b", "y"])
    x = np.column_stack([np.ones(len(rows)), rows["a"], rows["b"]])
    y = rows["y"].to_numpy()
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(z[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    cut = (z[order][k] + (z[order][k + 1] if k + 1 < len(z) else z[order][k])) / 2
    # A text without any term is never rejected, however few labels there are.
    cut = max(cut, float(w[0]) + 1.0)
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return Lexicon(lexicon.terms, lexicon.exceptions, float(w[0] + shift), (float(w[1]), float(w[2])))


def score_table(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add ``score`` (double, 0 to 1) and ``predicted`` (int) to every row, from the text alone.

    A null text counts as empty; rows are scored one by one, so ties, repeats
    and null ids need no rule. Columns called like the new ones are replaced.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)
        for part in parts:
            yield pd.Series([matcher.score(t) for t in part], dtype=float)

    scored = docs.withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
