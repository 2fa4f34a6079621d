"""Dumps of a paginated API and of the policy context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmeter import schemas


def read_pages(spark: SparkSession, path: str, item: T.StructType, multi_line: bool = False) -> DataFrame:
    """Rows of a dump: the items of ``results``, or the document itself.

    One JSON document per line, or per file with ``multi_line``. A page is
    bounded by the API's page size.
    """
    page = T.StructType([T.StructField("results", T.ArrayType(item)), *item.fields])
    reader = spark.read.schema(page)
    documents = (reader.option("multiLine", True) if multi_line else reader).json(path)
    own = F.array(F.struct(*[F.col(f.name) for f in item.fields]))
    rows = F.when(F.col("results").isNotNull(), F.col("results")).otherwise(own)
    return documents.select(F.inline(rows))


def parse_policy_context(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """Add ``policies``, the map from policy name to its settings."""
    whole = F.from_json(doc, f"struct<bgp_policies:{schemas.POLICY_CONTEXT}>")
    return documents.withColumn("policies", whole["bgp_policies"])


def policy_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per policy of the map."""
    return parsed.select(*keys, F.explode("policies").alias("policy_name", "_p")).select(
        *keys, "policy_name", "_p.as_path_prepend_count", "_p.local_preference"
    )
