"""Leaf paths and kinds of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter.functions import text
from pathmeter.operators import jsonpaths
from pathmeter.plans import views
from pathmeter.plans.registry import query

# The same text in both dialects: a nested document per order.
_DOC = """concat('{"id":', cast(o_orderkey as string), ',"device":{"name":"', o_orderpriority, '","price":', cast(o_totalprice as string),
 ',"tags":["a",', cast(o_orderkey % 7 as string), ',null,[true,{"deep":{"er":[[{"est":', cast(o_custkey as string),
 '}]]}}]]},"note":"long text: ', repeat('x', cast(o_orderkey % 60 as int)), '","empty":{},"none":[],"active":',
 case when o_orderkey % 2 = 0 then 'true' else 'false' end, '}')"""
_DOC_SQL = _DOC.replace("as string", "as varchar")
LEAVES_SQL = f"""
docs AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 40 = 7 THEN '{{"broken":' WHEN o_orderkey % 40 = 8 THEN '17'
                WHEN o_orderkey % 40 = 9 THEN '[1,{{"x":[]}},{{"x":2.5}}]' ELSE {_DOC_SQL} END AS doc FROM orders),
good AS (SELECT doc_id, CASE WHEN json_valid(doc) THEN doc ELSE '{{}}' END AS doc FROM docs),
leaves AS (
  SELECT doc_id, CASE WHEN t.fullkey LIKE '$.%' THEN substr(t.fullkey, 3) ELSE substr(t.fullkey, 2) END AS path,
         CASE WHEN t.type = 'NULL' THEN 'None' WHEN t.type = 'BOOLEAN' THEN upper(left(CAST(t.value AS VARCHAR), 1)) || substr(CAST(t.value AS VARCHAR), 2)
              ELSE t.value ->> '$' END AS value,
         CASE WHEN t.type = 'NULL' THEN 'NoneType' WHEN t.type = 'BOOLEAN' THEN 'bool' WHEN t.type = 'VARCHAR' THEN 'str'
              WHEN t.type = 'DOUBLE' THEN 'float' ELSE 'int' END AS type
  FROM good, json_tree(good.doc) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey <> '$')"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 40
    doc = (
        F.when(key == 7, F.lit('{"broken":'))
        .when(key == 8, F.lit("17"))
        .when(key == 9, F.lit('[1,{"x":[]},{"x":2.5}]'))
        .otherwise(F.expr(_DOC))
    )
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), doc.alias("doc"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonpaths.leaf_paths(documents(spark, sf_dir))


@query("jsn_01_leaf_paths", f"WITH {LEAVES_SQL} SELECT doc_id, path, value, type FROM leaves")
def jsn_01(spark, sf_dir):
    return leaves(spark, sf_dir)


@query("agg_17_leaf_types", f"WITH {LEAVES_SQL} SELECT type, count(*) AS n FROM leaves GROUP BY type")
def agg_17(spark, sf_dir):
    return jsonpaths.type_histogram(leaves(spark, sf_dir))


_PREVIEW = "CASE WHEN length(value) > 50 THEN left(value, 50) || '...' ELSE value END"


@query(
    "srt_02_sorted_paths",
    f"WITH {LEAVES_SQL} SELECT doc_id, path, value, type, {_PREVIEW} AS preview FROM leaves ORDER BY type, path, doc_id",
)
def srt_02(spark, sf_dir):
    return jsonpaths.listing(leaves(spark, sf_dir))


@query(
    "prj_25_value_preview",
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview FROM documents",
)
def prj_25(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


_KINDS = [
    ('{"results":[{"device_type":{"id":1},"name":"', '"}]}', "device"),
    ('{"results":[{"name":"', '","interface":{"id":3}}]}', "interfaces"),
    ('{"results":[{"remote_address":"', '"}]}', "sessions"),
    ('{"results":[{"remote_address":"', '","description":"my interface"}]}', "interfaces"),
    ('{"results":[],"name":"', '"}', "none"),
    ('{"device_type":{"id":2},"remote_address":"', '"}', "device"),
    ('{"remote_address":{"address":"', '"},"interfaces":[]}', "session"),
    ('{"interfaces":[],"bgp_sessions":[],"name":"', '"}', "device_with_interfaces"),
    ('{"bgp_sessions":[],"name":"', '"}', "device_with_sessions"),
    ('{"results":"text","interfaces":[],"name":"', '"}', "device_with_interfaces"),
    ('["', '"]', "none"),
]


@query(
    "prj_26_document_kind",
    "SELECT c_custkey AS doc_id, CASE c_custkey % 11 "
    + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, _, kind) in enumerate(_KINDS))
    + " END AS kind FROM customer",
)
def prj_26(spark, sf_dir):
    start = F.get(F.array(*[F.lit(a) for a, _, _ in _KINDS]), (F.col("c_custkey") % 11).cast("int"))
    end = F.get(F.array(*[F.lit(b) for _, b, _ in _KINDS]), (F.col("c_custkey") % 11).cast("int"))
    docs = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.concat(start, F.col("c_name"), end).alias("doc")
    )
    return docs.select("doc_id", text.document_kind("doc").alias("kind"))
