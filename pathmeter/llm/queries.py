"""The registered queries of the operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter.llm import alignment, audit, bpe, forest, lines, mixture, page_text, pii, search, secret_scan, shards, simhash, toxicity
from pathmeter.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values of each kind."""
    done = pii.pseudonymise(table(spark, sf_dir, "documents"), key="production-key-1")
    counts = [secret_scan.count_of(k, "pii_spans").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", "text", *counts)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_table(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    return found.select(
        "doc_id",
        *[secret_scan.count_of(k).alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.joined(F.filter("spans", lambda s: s["ord"] < len(base))), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query
def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the calibrated sample with their cell and probability."""
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "probability")


@query
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.interleave(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs of 50 words or more."""
    return lines.delete_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


@query
def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


ORACLE_SQL["op9_top_products"] = """
    WITH v AS (
        SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), p AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANK_FILE, PATTERN)


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, by language."""
    counts = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(counts)


ORACLE_SQL["op12_filter_audit"] = audit.ORACLE_SQL


@query
def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document."""
    return alignment.audit(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
