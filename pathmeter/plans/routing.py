"""Policy rules, prefix lists and communities, and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmeter import session
from pathmeter.functions import text
from pathmeter.operators import policy
from pathmeter.plans import views
from pathmeter.plans.registry import query
from pathmeter.sources import dumps

# ------------------------------------------------------------------------ views


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rule_id"),
        F.col("o_custkey").alias("device_key"),
        F.expr(
            """case o_orderkey % 6 when 0 then 'EXPORT-TO-IXA' when 1 then 'EXPORT-TO-UFINET'
               when 2 then 'SET-LOCAL-PREF-IXA' when 3 then 'SET-LOCAL-PREF-UFINET' else o_orderpriority end"""
        ).alias("policy_name"),
        F.expr("case when o_orderkey % 11 = 0 then null else cast(o_orderkey % 4 as int) end").alias("as_path_prepend_count"),
        F.expr(
            "case when o_orderstatus = 'F' then null when o_orderstatus = 'P' and o_orderkey % 9 = 0 then '' "
            "else cast(100 * (o_orderkey % 2 + 1) as string) end"
        ).alias("local_preference"),
        F.expr(
            "case o_orderkey % 3 when 0 then concat('COMM-', cast(o_custkey as string)) "
            "when 1 then concat('65000:', cast(o_custkey as string)) end"
        ).alias("apply_community"),
        F.expr(
            """case o_orderkey % 4 when 0 then cast(array() as array<string>) when 1 then array('PL-A')
               else array('PL-B', concat('PL-', cast(o_custkey as string))) end"""
        ).alias("match_ipv6_address"),
        F.expr("case o_orderkey % 8 when 0 then cast(array() as array<string>) else array('PL4-A', 'PL4-B') end").alias(
            "match_ip_address"
        ),
    )


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth community is named like its value."""
    value = F.expr("concat('65000:', cast(c_custkey as string))")
    name = F.when(F.col("c_custkey") % 50 == 0, value).otherwise(F.expr("concat('COMM-', cast(c_custkey as string))"))
    return views.table(spark, sf_dir, "customer").select(name.alias("name"), value.alias("value"))


def prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(
        F.expr("concat('PL-', p_brand)").alias("list_name"),
        F.expr("case when p_brand like '%3' then 'other' when p_brand like '%2' then 'ipv4' else 'ipv6' end").alias("family"),
        F.col("p_size").alias("index"),
        F.expr("case p_size % 3 when 0 then 'permit' when 1 then 'deny' else 'log' end").alias("action"),
        F.expr("concat('10.', cast(p_partkey div 256 % 256 as string), '.', cast(p_partkey % 256 as string), '.0')").alias("ip"),
        F.expr("8 + cast(p_partkey % 25 as int)").alias("prefixlen"),
        F.col("p_partkey").alias("position"),
    )


RULES_SQL = """
rule AS (
  SELECT o_orderkey AS rule_id, o_custkey AS device_key,
         CASE o_orderkey % 6 WHEN 0 THEN 'EXPORT-TO-IXA' WHEN 1 THEN 'EXPORT-TO-UFINET' WHEN 2 THEN 'SET-LOCAL-PREF-IXA'
              WHEN 3 THEN 'SET-LOCAL-PREF-UFINET' ELSE o_orderpriority END AS policy_name,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INTEGER) END AS as_path_prepend_count,
         CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 9 = 0 THEN ''
              ELSE CAST(100 * (o_orderkey % 2 + 1) AS VARCHAR) END AS local_preference,
         CASE o_orderkey % 3 WHEN 0 THEN 'COMM-' || CAST(o_custkey AS VARCHAR)
              WHEN 1 THEN '65000:' || CAST(o_custkey AS VARCHAR) END AS apply_community,
         CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['PL-A']
              ELSE ['PL-B', 'PL-' || CAST(o_custkey AS VARCHAR)] END AS match_ipv6_address,
         CASE o_orderkey % 8 WHEN 0 THEN CAST([] AS VARCHAR[]) ELSE ['PL4-A', 'PL4-B'] END AS match_ip_address
  FROM orders),
community AS (
  SELECT CASE WHEN c_custkey % 50 = 0 THEN '65000:' ELSE 'COMM-' END || CAST(c_custkey AS VARCHAR) AS name,
         '65000:' || CAST(c_custkey AS VARCHAR) AS value FROM customer),
prefix_rule AS (
  SELECT 'PL-' || p_brand AS list_name,
         CASE WHEN p_brand LIKE '%3' THEN 'other' WHEN p_brand LIKE '%2' THEN 'ipv4' ELSE 'ipv6' END AS family, p_size AS index,
         CASE p_size % 3 WHEN 0 THEN 'permit' WHEN 1 THEN 'deny' ELSE 'log' END AS action,
         concat('10.', CAST(p_partkey // 256 % 256 AS VARCHAR), '.', CAST(p_partkey % 256 AS VARCHAR), '.0') AS ip,
         8 + CAST(p_partkey % 25 AS INTEGER) AS prefixlen, p_partkey AS position FROM part),
first_rule AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY position) AS rn FROM prefix_rule) x
               WHERE rn = 1),
last_rule AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_key, policy_name ORDER BY rule_id DESC) AS rn,
                        min(rule_id) OVER (PARTITION BY device_key, policy_name) AS first_position FROM rule) x WHERE rn = 1)"""
PREPEND_SQL = """CASE WHEN as_path_prepend_count = 0 THEN ' undo apply as-path'
     WHEN as_path_prepend_count > 0 THEN ' apply as-path ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), as_path_prepend_count, '65000'), ' ')
          || ' additive' END"""

KEYS = ["device_key", "policy_name"]


# ---------------------------------------------------------------------- sources


def _page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of fifty orders each, and nations as single objects."""
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    pages = (
        views.table(spark, sf_dir, "orders")
        .groupBy(F.expr("o_orderkey div 50"))
        .agg(F.collect_list(item).alias("results"))
        .select(F.to_json(F.struct(F.size("results").alias("count"), "results")).alias("value"))
    )
    single = views.table(spark, sf_dir, "nation").select(
        F.to_json(F.struct((-1 - F.col("n_nationkey")).cast("bigint").alias("id"), F.col("n_name").alias("name"))).alias("value")
    )
    return pages.unionByName(single)


@query(
    "src_05_api_pages",
    """SELECT o_orderkey AS id, o_orderpriority AS name FROM orders
UNION ALL SELECT CAST(-1 - n_nationkey AS BIGINT), n_name FROM nation""",
)
def src_05(spark, sf_dir):
    path = session.scratch_dir(spark, "pages")
    _page_documents(spark, sf_dir).write.text(path)
    item = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return dumps.read_pages(spark, path, item)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy-context document per order: its own policy and a fixed second one."""
    doc = F.expr(
        """concat('{"bgp_policies": {"', o_orderpriority, '": {"as_path_prepend_count": ', cast(o_orderkey % 4 as string),
           ', "local_preference": ', cast(100 + o_orderkey % 3 as string),
           '}, "EXPORT-TO-UFINET": {"as_path_prepend_count": 2, "local_preference": ', cast(o_custkey as string), '}}}')"""
    )
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), doc.alias("doc"))


@query(
    "src_06_policy_context",
    """SELECT o_orderkey AS doc_id, 2 AS n_policies, 2 AS ufinet_prepend, CAST(o_custkey AS INTEGER) AS ufinet_preference
FROM orders""",
)
def src_06(spark, sf_dir):
    parsed = dumps.parse_policy_context(_contexts(spark, sf_dir))
    entry = F.col("policies")["EXPORT-TO-UFINET"]
    return parsed.select(
        "doc_id",
        F.size("policies").alias("n_policies"),
        entry["as_path_prepend_count"].alias("ufinet_prepend"),
        entry["local_preference"].alias("ufinet_preference"),
    )


@query(
    "jsn_02_policy_map_rows",
    """SELECT o_orderkey AS doc_id, o_orderpriority AS policy_name, CAST(o_orderkey % 4 AS INTEGER) AS as_path_prepend_count,
       CAST(100 + o_orderkey % 3 AS INTEGER) AS local_preference FROM orders
UNION ALL SELECT o_orderkey, 'EXPORT-TO-UFINET', 2, CAST(o_custkey AS INTEGER) FROM orders""",
)
def jsn_02(spark, sf_dir):
    return dumps.policy_rows(dumps.parse_policy_context(_contexts(spark, sf_dir)), ["doc_id"])


# -------------------------------------------------------------- filters and joins


@query(
    "flt_04_policy_names",
    f"""WITH {RULES_SQL}
SELECT rule_id, policy_name FROM rule
WHERE policy_name IN ('EXPORT-TO-IXA', 'EXPORT-TO-UFINET', 'SET-LOCAL-PREF-IXA', 'SET-LOCAL-PREF-UFINET')""",
)
def flt_04(spark, sf_dir):
    return policy.rendered_rules(rules(spark, sf_dir)).select("rule_id", "policy_name")


@query(
    "joi_04_session_policies",
    """WITH s AS (
  SELECT c_custkey AS session_id,
         CASE c_custkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['EXPORT-TO-IXA']
              ELSE ['EXPORT-TO-IXA', 'EXPORT-TO-UFINET'] END AS e,
         CASE WHEN c_custkey % 2 = 0 THEN ['IMPORT-' || c_mktsegment] ELSE CAST([] AS VARCHAR[]) END AS i FROM customer)
SELECT session_id, 'export' AS direction, unnest(CASE WHEN len(e) = 0 THEN [NULL] ELSE e END) AS policy FROM s
UNION ALL SELECT session_id, 'import', unnest(CASE WHEN len(i) = 0 THEN [NULL] ELSE i END) FROM s""",
)
def joi_04(spark, sf_dir):
    from pathmeter.plans import network

    return policy.session_policies(network.sessions(spark, sf_dir))


@query(
    "joi_05_rule_communities",
    f"""WITH {RULES_SQL}
SELECT r.rule_id, r.apply_community, c.name, c.value
FROM rule r JOIN community c ON c.name = r.apply_community OR c.value = r.apply_community""",
)
def joi_05(spark, sf_dir):
    return policy.rule_communities(rules(spark, sf_dir), communities(spark, sf_dir))


@query(
    "joi_06_match_lists",
    f"""WITH {RULES_SQL},
c AS (SELECT rule_id, CASE WHEN len(match_ipv6_address) > 0 THEN 'ipv6' WHEN len(match_ip_address) > 0 THEN 'ip' END AS family,
             CASE WHEN len(match_ipv6_address) > 0 THEN match_ipv6_address ELSE match_ip_address END AS chosen FROM rule)
SELECT rule_id, family, unnest(CASE WHEN len(chosen) = 0 THEN [NULL] ELSE chosen END) AS prefix_list FROM c""",
)
def joi_06(spark, sf_dir):
    return policy.match_lists(rules(spark, sf_dir))


@query(
    "agg_16_last_rule_wins",
    f"""WITH {RULES_SQL}
SELECT device_key, policy_name, rule_id, first_position, local_preference, as_path_prepend_count FROM last_rule""",
)
def agg_16(spark, sf_dir):
    cut = rules(spark, sf_dir).select(*KEYS, "rule_id", "local_preference", "as_path_prepend_count")
    return policy.last_rule_wins(cut, KEYS, "rule_id")


@query(
    "win_05_first_rule_per_list",
    f"WITH {RULES_SQL} SELECT list_name, family, index, action, ip, prefixlen FROM first_rule",
)
def win_05(spark, sf_dir):
    return policy.first_rule_per_list(prefix_rules(spark, sf_dir), ["list_name"], "position").drop("position")


# ------------------------------------------------------------------- map fields


def _fields(name: str, *parts: str):
    return F.expr(f"map({', '.join(parts)})").alias(name)


def _with_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom fields of each rule and the update meant for it; every seventh clears a field."""
    fields = _fields(
        "custom_fields",
        "'apply_community', apply_community",
        "'local_preference', local_preference",
        "'as_path_prepend_count', cast(as_path_prepend_count as string)",
    )
    updates = F.expr(
        """case when rule_id % 7 = 0 then map('apply_community', cast(null as string))
                when rule_id % 2 = 0 then map('local_preference', '200', 'note', 'primary')
                else map('as_path_prepend_count', '3') end"""
    )
    return rules(spark, sf_dir).select("rule_id", fields, updates.alias("updates"))


@query(
    "jsn_03_custom_field_lookup",
    f"""WITH {RULES_SQL}
SELECT rule_id, apply_community, local_preference, CAST(as_path_prepend_count AS VARCHAR) AS as_path_prepend_count,
       CAST(NULL AS VARCHAR) AS unknown FROM rule""",
)
def jsn_03(spark, sf_dir):
    names = ["apply_community", "local_preference", "as_path_prepend_count", "unknown"]
    return _with_updates(spark, sf_dir).select("rule_id", *[F.try_element_at("custom_fields", F.lit(n)).alias(n) for n in names])


@query(
    "jsn_04_custom_field_merge",
    f"""WITH {RULES_SQL}
SELECT rule_id, CASE WHEN rule_id % 7 = 0 THEN NULL ELSE apply_community END AS apply_community,
       CASE WHEN rule_id % 7 <> 0 AND rule_id % 2 = 0 THEN '200' ELSE local_preference END AS local_preference,
       CASE WHEN rule_id % 7 <> 0 AND rule_id % 2 <> 0 THEN '3' ELSE CAST(as_path_prepend_count AS VARCHAR) END AS as_path_prepend_count,
       CASE WHEN rule_id % 7 <> 0 AND rule_id % 2 = 0 THEN 'primary' END AS note,
       CASE WHEN rule_id % 7 <> 0 AND rule_id % 2 = 0 THEN 4 ELSE 3 END AS n_fields FROM rule""",
)
def jsn_04(spark, sf_dir):
    merged = _with_updates(spark, sf_dir).withColumn("m", text.merge_fields("custom_fields", "updates"))
    names = ["apply_community", "local_preference", "as_path_prepend_count", "note"]
    return merged.select(
        "rule_id", *[F.try_element_at("m", F.lit(n)).alias(n) for n in names], F.size("m").alias("n_fields")
    )


# ---------------------------------------------------------------- command rows


@query(
    "arr_01_prepend_text",
    f"WITH {RULES_SQL} SELECT rule_id, as_path_prepend_count, {PREPEND_SQL} AS text FROM rule",
)
def arr_01(spark, sf_dir):
    return rules(spark, sf_dir).select(
        "rule_id", "as_path_prepend_count", policy.prepend_text("as_path_prepend_count").alias("text")
    )


@query(
    "arr_02_policy_commands",
    f"""WITH {RULES_SQL},
l AS (SELECT device_key, policy_name, list_filter(list_concat(
        ['route-policy ' || policy_name || ' permit node 10'],
        list_transform(match_ipv6_address, lambda p: ' if-match ipv6 address prefix-list ' || p),
        [CASE WHEN apply_community <> '' THEN ' apply community ' || apply_community END,
         CASE WHEN local_preference <> '' THEN ' apply local-preference ' || local_preference END, {PREPEND_SQL}, 'quit']),
        lambda x: x IS NOT NULL) AS lines FROM last_rule)
SELECT device_key, policy_name, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS text
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) x""",
)
def arr_02(spark, sf_dir):
    last = policy.last_rule_wins(rules(spark, sf_dir), KEYS, "rule_id")
    return policy.policy_commands(last, KEYS)


def policy_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS numbers of two thirds of the policies' devices; every thirteenth of these has none."""
    return views.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("device_key"),
        F.expr("case when c_custkey % 13 <> 0 then 64512 + c_custkey end").alias("local_asn"),
    )


DEVICE_SQL = """dev AS (SELECT c_custkey AS device_key, CASE WHEN c_custkey % 13 <> 0 THEN 64512 + c_custkey END AS local_asn
  FROM customer WHERE c_custkey % 3 <> 0)"""
DEVICE_PREPEND_SQL = PREPEND_SQL.replace("'65000'", "coalesce(CAST(local_asn AS VARCHAR), 'None')")


@query(
    "arr_01_device_prepend_text",
    f"""WITH {RULES_SQL}, {DEVICE_SQL}
SELECT rule_id, as_path_prepend_count, {DEVICE_PREPEND_SQL} AS text FROM rule LEFT JOIN dev USING (device_key)""",
)
def arr_01_device(spark, sf_dir):
    """The AS-path command of every rule with the number of its own device."""
    numbered = policy.device_asn(rules(spark, sf_dir), policy_devices(spark, sf_dir))
    return numbered.select(
        "rule_id", "as_path_prepend_count", policy.prepend_text("as_path_prepend_count", F.col("asn")).alias("text")
    )


@query(
    "arr_02_device_policy_commands",
    f"""WITH {RULES_SQL}, {DEVICE_SQL},
l AS (SELECT device_key, policy_name, list_filter(list_concat(
        ['route-policy ' || policy_name || ' permit node 10'],
        list_transform(match_ipv6_address, lambda p: ' if-match ipv6 address prefix-list ' || p),
        [CASE WHEN apply_community <> '' THEN ' apply community ' || apply_community END,
         CASE WHEN local_preference <> '' THEN ' apply local-preference ' || local_preference END, {DEVICE_PREPEND_SQL}, 'quit']),
        lambda x: x IS NOT NULL) AS lines FROM last_rule LEFT JOIN dev USING (device_key))
SELECT device_key, policy_name, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS text
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) x""",
)
def arr_02_device(spark, sf_dir):
    """Policy commands in which each device prepends its own AS number."""
    last = policy.last_rule_wins(rules(spark, sf_dir), KEYS, "rule_id")
    numbered = policy.device_asn(last, policy_devices(spark, sf_dir))
    return policy.policy_commands(numbered, KEYS, F.col("asn"))


@query(
    "arr_02_rule_commands",
    f"""WITH {RULES_SQL},
r AS (SELECT *, CASE WHEN rule_id % 5 = 0 THEN 'deny' ELSE 'permit' END AS action, CAST(rule_id % 100 AS INTEGER) AS index,
             CASE WHEN len(match_ipv6_address) > 0 THEN 'ipv6' ELSE 'ip' END AS fam,
             CASE WHEN len(match_ipv6_address) > 0 THEN match_ipv6_address ELSE match_ip_address END AS chosen
      FROM rule WHERE policy_name IN ('EXPORT-TO-IXA', 'EXPORT-TO-UFINET', 'SET-LOCAL-PREF-IXA', 'SET-LOCAL-PREF-UFINET')),
m AS (SELECT rule_id, fam, unnest(chosen) AS pl FROM r)
SELECT rule_id, 1 AS step, '' AS item, 'route-policy ' || policy_name || ' ' || action || ' node ' || CAST(index AS VARCHAR) AS text FROM r
UNION ALL SELECT rule_id, 2, pl, ' if-match ' || fam || ' address prefix-list ' || pl FROM m
UNION ALL SELECT rule_id, 3, c.name, ' apply community ' || c.value
          FROM r JOIN community c ON c.name = r.apply_community OR c.value = r.apply_community
UNION ALL SELECT rule_id, 4, '', ' apply local-preference ' || local_preference FROM r WHERE local_preference <> ''
UNION ALL SELECT rule_id, 5, '', ' apply as-path 65000 65000 65000 additive' FROM r WHERE as_path_prepend_count > 0
UNION ALL SELECT rule_id, 6, '', 'quit' FROM r""",
)
def arr_02_rules(spark, sf_dir):
    numbered = rules(spark, sf_dir).withColumns(
        {
            "action": F.when(F.col("rule_id") % 5 == 0, "deny").otherwise("permit"),
            "index": (F.col("rule_id") % 100).cast("int"),
        }
    )
    return policy.rule_commands(numbered, communities(spark, sf_dir))


@query(
    "arr_01_context_commands",
    """WITH p AS (
  SELECT o_orderkey AS doc_id, o_orderpriority AS policy_name, o_orderkey % 4 AS n, 100 + o_orderkey % 3 AS lp FROM orders
  UNION ALL SELECT o_orderkey, 'EXPORT-TO-UFINET', 2, o_custkey FROM orders),
l AS (SELECT doc_id, policy_name, list_filter(['route-policy ' || policy_name || ' permit node 10',
             CASE WHEN n > 0 THEN ' apply as-path 65000 65000 additive' END,
             CASE WHEN lp <> 0 THEN ' apply local-preference ' || CAST(lp AS VARCHAR) END, 'quit'], lambda x: x IS NOT NULL) AS lines FROM p)
SELECT doc_id, policy_name, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS text
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) x""",
)
def arr_01_context(spark, sf_dir):
    rows = dumps.policy_rows(dumps.parse_policy_context(_contexts(spark, sf_dir)), ["doc_id"])
    return policy.context_commands(rows, ["doc_id"])


@query(
    "arr_04_prefix_list_commands",
    f"""WITH {RULES_SQL}
SELECT list_name, CASE family WHEN 'ipv4' THEN 'ip ip-prefix' ELSE 'ip ipv6-prefix' END || ' ' || list_name || ' index '
       || CAST(index AS VARCHAR) || ' ' || CASE action WHEN 'permit' THEN 'permit' ELSE 'deny' END || ' ' || ip || ' '
       || CAST(prefixlen AS VARCHAR) AS text
FROM first_rule WHERE family <> 'other'""",
)
def arr_04(spark, sf_dir):
    return policy.prefix_list_commands(
        policy.first_rule_per_list(prefix_rules(spark, sf_dir), ["list_name"], "position")
    )


@query(
    "arr_03_network_commands",
    f"""WITH {RULES_SQL}
SELECT position, ' network ' || ip || ' ' || CAST(prefixlen AS VARCHAR) AS text FROM prefix_rule""",
)
def arr_03_networks(spark, sf_dir):
    return policy.network_commands(prefix_rules(spark, sf_dir))


# ------------------------------------------------------------------------ drift

_STRIP_SQL = "(SELECT string_agg(chr(c), '') FROM (VALUES " + ", ".join(f"({ord(c)})" for c in text.WHITESPACE) + ") v(c))"


@query(
    "joi_10_config_drift",
    f"""WITH ws AS (SELECT {_STRIP_SQL} AS chars),
d AS (SELECT doc_id AS device_id, trim(CASE WHEN doc_id % 10 = 0 THEN chr(10) || '  ' ELSE text END, chars) AS t FROM documents, ws
      WHERE doc_id % 12 <> 5),
c AS (SELECT doc_id AS device_id, trim(CASE doc_id % 4 WHEN 0 THEN chr(10) || ' ' || text || chr(160) || chr(10)
                                            WHEN 1 THEN text || ' changed' ELSE text END, chars) AS t
      FROM documents, ws WHERE doc_id % 4 <> 2)
SELECT coalesce(d.device_id, c.device_id) AS device_id, sha256(d.t) AS desired_sha, sha256(c.t) AS current_sha,
       CASE WHEN coalesce(d.t, '') = '' THEN 'skipped_empty' WHEN c.t IS NULL THEN 'new'
            WHEN c.t = d.t THEN 'unchanged' ELSE 'changed' END AS status
FROM d FULL JOIN c ON c.device_id = d.device_id""",
)
def joi_10(spark, sf_dir):
    """Desired and current configuration texts, some missing on either side."""
    documents = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("device_id"), "text")
    desired = documents.where("device_id % 12 <> 5").withColumn(
        "text", F.when(F.col("device_id") % 10 == 0, F.lit("\n  ")).otherwise(F.col("text"))
    )
    kind = F.col("device_id") % 4
    current = documents.where("device_id % 4 <> 2").withColumn(
        "text",
        F.when(kind == 0, F.concat(F.lit("\n "), F.col("text"), F.lit("\xa0\n")))
        .when(kind == 1, F.concat(F.col("text"), F.lit(" changed")))
        .otherwise(F.col("text")),
    )
    return policy.drift(desired, current)
