"""The corpus pipeline: five stages over ``documents``, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathmeter.llm import bpe, lines, mixture, simhash, toxicity
from pathmeter.llm.common import table
from pathmeter.llm.queries import PATTERN, RANK_FILE
from pathmeter.session import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon learned from the labels does not reject."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_table(docs, lexicon)
    return scored.where("predicted = 0").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later copies of line runs of 50 words or more cut from their texts."""
    return lines.delete_repeats(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with a shingle similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with calibrated token weights of sources, languages and topics."""
    return mixture.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding them gives the text back."""
    return bpe.encode_checked(docs, RANK_FILE, PATTERN).select("doc_id", "source", "lang", "token_ids", "n_tokens", "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("mixture", mixed),
    ("byte_bpe", encoded),
]

#: The stages learn, rank and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
