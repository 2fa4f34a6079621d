"""Mixing sources to target weights by iterative proportional fitting (operator 6)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter.llm.common import text_key
from pathmeter.session import materialize

SEED = 6
#: Relative error of every marginal at which raking ends, and rounds without a better one after which it is given up.
TOLERANCE = 1e-3
STALLED = 3
#: Targets follow the tokens of a value to this power, which lifts small sources.
TEMPER = 0.7
#: Relative error of the expected marginals that the largest sample may have.
OFF = 0.01
DIMENSIONS = ("source", "lang", "topic")

#: A topic is the first of these whose pattern a text holds, else prose.
TOPICS = (
    ("legal", r"(?i)licen[sc]e|copyright|warranty"),
    ("technical", r"https?://|[{}<>]|\bAKIA|=\s*[\"']"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+\d{1,3} \("),
)


def tokens(text: str = "text") -> Column:
    """Tokens of a text as its words between white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    out = None
    for name, pattern in TOPICS:
        hit = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("prose")


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """(value, target) of a dimension: shares of the tokens raised to ``power``, summing to one."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    total = sums.agg(F.sum(F.pow("t", F.lit(power)))).first()[0] or 1.0
    return sums.select("value", (F.pow("t", F.lit(power)) / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Add ``weight`` to cells (dimensions..., tokens): shares whose marginals are the targets.

    Starts from the cells' share of the tokens and scales to one dimension's
    targets after the other until all marginals agree. Values without a target
    get weight zero, targets without a cell are left out. Raking goes on until
    every marginal is within TOLERANCE; targets that contradict each other never
    are, which a warning says, and then the last dimension holds. Cells are aggregates, one
    row per combination of values; they stay distributed, and each scaling is
    written, which keeps plans short and cuts the lineage.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    state = materialize(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "raked")
    goals = {d: materialize(t.select(F.col("value").alias(f"_{d}"), "target").where("target > 0"), "targets") for d, t in targets.items()}
    best, stalled = float("inf"), 0
    while True:
        errors = {}
        for d, goal in goals.items():
            factors = materialize(_factors(state, d, goal), "factors")
            off = F.abs(F.col("_sum") - F.col("_target")) / F.greatest("_target", F.lit(1e-12))
            errors[d] = factors.agg(F.max(off)).first()[0] or 0.0
            state = materialize(_scaled(state, d, factors), "raked")
        worst = max(errors, key=errors.get)
        if errors[worst] <= TOLERANCE:
            return state
        stalled = 0 if errors[worst] < 0.99 * best else stalled + 1
        best = min(best, errors[worst])
        if stalled >= STALLED:
            warnings.warn(f"raking ends with {worst} off its targets by {errors[worst]:.3g}; the targets contradict each other", stacklevel=2)
            return state


def _factors(state: DataFrame, d: str, goal: DataFrame) -> DataFrame:
    sums = state.groupBy(F.col(d).alias("_value")).agg(F.sum("weight").alias("_sum"))
    known = sums.join(goal, F.col("_value").eqNullSafe(F.col(f"_{d}")), "left")
    return known.select("_value", "_sum", F.coalesce("target", F.lit(0.0)).alias("_target"))


def _scaled(state: DataFrame, d: str, factors: DataFrame) -> DataFrame:
    joined = state.join(factors, F.col(d).eqNullSafe(F.col("_value")))
    new = F.when(F.col("_sum") > 0, F.col("weight") * F.col("_target") / F.col("_sum")).otherwise(F.lit(0.0))
    return joined.withColumn("weight", new).drop("_value", "_sum", "_target")


def scale_for(ratio: DataFrame, keep: float | None) -> float:
    """The factor c for which min(1, c * ratio) keeps the share ``keep`` of the tokens; None: the largest that holds the marginals.

    Aggregations over two grids of factors find it to a part in a thousand or so.
    """
    low, high = ratio.where("_ratio > 0").agg(F.min("_ratio"), F.max("_ratio")).first()
    if high is None:
        return 1.0
    lo, hi = 1.0 / high / (64 if keep is not None else 1), 1.0 / low
    for _ in range(2):
        steps = [lo * (hi / lo) ** (i / 64) for i in range(65)]
        held = [F.sum(F.least(F.lit(1.0), F.col("_ratio") * c) * F.col("tokens")).alias(f"h{i}") for i, c in enumerate(steps)]
        if keep is None:
            worst = _worst_errors(ratio, held)
            k = next((i for i in range(65) if worst[i] > OFF), 65)
            lo, hi = steps[max(0, k - 1)], steps[min(64, k)]
        else:
            row = ratio.agg(F.sum("tokens"), *held).first()
            k = next((i for i in range(65) if row[i + 1] >= keep * row[0]), 64)
            lo, hi = steps[max(0, k - 1)], steps[k]
    return lo if keep is None else hi


def _worst_errors(ratio: DataFrame, held: list[Column]) -> list[float]:
    """For each sum of held tokens the largest relative error of a marginal against that of the weights."""
    whole = ratio.agg(F.sum("weight"), *held).first()
    worst = [0.0] * len(held)
    for d in DIMENSIONS:
        sums = ratio.where("weight > 0").groupBy(d).agg(F.sum("weight").alias("_w"), *held)
        errors = [F.max(F.abs(F.col(f"h{i}") / F.lit(float(whole[i + 1])) / (F.col("_w") / F.lit(float(whole[0]))) - 1)) for i in range(len(held))]
        worst = [max(a, b or 0.0) for a, b in zip(worst, sums.agg(*errors).first())]
    return worst


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float | None = None, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Sample rows so that the expected tokens of the sample have the target marginals.

    Cells are the combinations of source, language and topic. Raking gives each
    the weight it should have; weight over tokens, times one factor, is the
    probability of its rows, and a row stays if a uniform hash of key and text
    lies below it. A probability above one means all rows of a scarce cell, which
    then falls short. With ``keep`` None the factor is the largest at which the
    expected share of no value is off that of the raked weights by more than OFF
    of it. With a number the sample holds the share ``keep`` of the tokens, and
    scarce values may fall far short of their targets. Without ``targets`` each dimension aims at its tokens to the power 0.7. Returns the kept rows with ``tokens``,
    ``topic`` and ``probability`` (columns of these names are replaced). A null
    source or language is a value of its own. Cells without tokens (null and
    empty texts) change no marginal and stay. Rows equal in key and text stay
    or go together; the result depends on the rows alone, not on their order.
    """
    columns = [c for c in docs.columns if c not in ("tokens", "topic", "probability")]
    # 53 bits of the hash, so the quotient is exact and below one.
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), text_key(text)), 11) / F.lit(float(1 << 53))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        "source", "lang", topic(text).alias("topic"), tokens(text).alias("tokens"), uniform.alias("uniform"),
    )
    # Stored once, so that the patterns run once over every text.
    base = materialize(base, "mixture-rows")
    cells = materialize(base.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {d: tempered(cells.where("tokens > 0"), d) for d in DIMENSIONS}
    raked = rake(cells.where("tokens > 0"), targets)
    ratio = raked.withColumn("_ratio", F.col("weight") / F.col("tokens"))
    p = F.least(F.lit(1.0), F.col("_ratio") * scale_for(ratio, keep))
    chance = materialize(ratio.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], p.alias("_p")), "chances")
    on = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    joined = base.join(chance, on[0] & on[1] & on[2], "left")
    kept = joined.withColumn("probability", F.coalesce("_p", F.lit(1.0))).where(F.col("uniform") < F.col("probability"))
    return kept.select(*[F.col("row")[c].alias(c) for c in columns], "tokens", "topic", "probability")
