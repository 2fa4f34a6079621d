"""Sharding by proportional stratified interleaving (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmeter.llm.common import numbered, text_key
from pathmeter.session import materialize

SEED = 7
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text and a fixed part; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def interleave(docs: DataFrame, shards: int, strata: tuple[str, ...] = ("source",), key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Deal rows to ``shards`` shards of equal row counts, each with the mixture of the whole.

    Rows are shuffled within their stratum by a seeded hash and get the
    fractional rank (rank + 1/2) / rows of the stratum. In the order of
    fractional ranks every stretch holds the strata in proportion; it is cut
    into shards whose row counts differ by one at most. Returns (key, size,
    text_crc32, strata..., fraction, shard, slot), slot gapless from 0. The
    text of a row is only measured, never moved. Nulls in a stratum are one
    more value of it; a null key or text takes part; repeated rows each get a
    slot of their own; no rows give no shards.
    """
    crc = F.coalesce(F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.lit(0)).cast("long")
    names = [f"_s{i}" for i in range(len(strata))]
    rows = docs.select(
        F.col(key).alias("_key"), text_size(text).alias("size"), crc.alias("text_crc32"),
        *[F.col(f"`{s}`").alias(n) for s, n in zip(strata, names)],
        F.xxhash64(F.lit(seed), F.col(key), text_key(text)).alias("_h"),
    )
    ranked = numbered(rows, [*names, "_h", "_key"], "_place", "strata")
    # A stratum's rows have successive places, so its first place and its size give the rank.
    sizes = ranked.groupBy(*names).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    on = same[0]
    for more in same[1:]:
        on = on & more
    joined = ranked.alias("r").join(materialize(sizes, "strata-sizes").alias("s"), on)
    fraction = (F.col("_place") - F.col("_first") + 0.5) / F.col("_n")
    ranked = joined.select("_key", "size", "text_crc32", *[f"r.{n}" for n in names], "_h", fraction.alias("fraction"))
    placed = numbered(ranked, ["fraction", *names, "_h", "_key"], "_place", "interleaved")
    total = max(1, placed.count())
    # Exact integer arithmetic: shard s starts at the least place p with p * shards >= s * total.
    out = placed.withColumn("_shard", F.expr(f"_place * {int(shards)}L div {total}L"))
    out = out.withColumn("_start", F.expr(f"(_shard * {total}L + {int(shards) - 1}L) div {int(shards)}L"))
    return out.select(
        F.col("_key").alias(key), "size", "text_crc32", *[F.col(n).alias(s) for s, n in zip(strata, names)], "fraction",
        F.col("_shard").cast("int").alias("shard"), (F.col("_place") - F.col("_start")).alias("slot"),
    )
