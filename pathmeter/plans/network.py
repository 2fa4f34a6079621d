"""Inventory of devices, interfaces, addresses and sessions, and queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter.functions import address
from pathmeter.operators import inventory
from pathmeter.plans import views
from pathmeter.plans.registry import query

# ------------------------------------------------------------------------ views


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("device_id"),
        F.col("s_name").alias("name"),
        F.expr("s_nationkey % 16").alias("site_id"),
        F.expr(
            "case when s_acctbal > 0 then concat('10.0.', cast(s_suppkey div 256 as string), '.', "
            "cast(s_suppkey % 256 as string), '/32') end"
        ).alias("primary_ip4"),
        F.expr("case when s_acctbal > 0 then s_suppkey end").alias("primary_ip_id"),
    )


def primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address rows the devices' primary ids point to."""
    rows = devices(spark, sf_dir).where("primary_ip_id is not null")
    return rows.select(F.col("primary_ip_id").alias("address_id"), F.col("primary_ip4").alias("address"))


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("interface_id"),
        (F.col("p_partkey") % views.supplier_count(spark, sf_dir)).alias("device_id"),
        F.expr(
            "case when p_size % 10 = 0 then concat('LoopBack', cast(p_partkey as string)) "
            "else concat('Ethernet1/0/', cast(p_partkey as string)) end"
        ).alias("name"),
        F.expr("case when p_size % 3 = 0 then '' else p_name end").alias("description"),
        F.expr("p_size % 7 <> 0").alias("enabled"),
        F.expr("case when p_size % 2 = 0 then 4 else 6 end").alias("family"),
        F.col("p_brand").alias("manufacturer"),
        F.col("p_type").alias("platform"),
        F.expr("case when p_size % 2 = 0 then 'active' else 'planned' end").alias("status"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_parts = views.table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("address_id"),
        (F.col("o_orderkey") % n_parts).alias("interface_id"),
        F.expr(
            "case when o_orderkey % 2 = 0 then concat('10.', cast(o_orderkey div 65536 % 256 as string), '.', "
            "cast(o_orderkey div 256 % 256 as string), '.', cast(o_orderkey % 256 as string), '/', "
            "cast(o_orderkey % 33 as string)) "
            "else concat('2001:db8:', cast(o_orderkey div 10000 as string), '::', cast(o_orderkey % 10000 as string), '/64') end"
        ).alias("address"),
        F.expr("case when o_orderkey % 2 = 0 then 4 else 6 end").alias("family"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.col("c_custkey") % views.supplier_count(spark, sf_dir)
    return (
        views.table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment", device.alias("device_id"))
        .select(
            F.col("c_custkey").alias("session_id"),
            "device_id",
            F.expr("concat('Supplier#', lpad(cast(device_id as string), 9, '0'))").alias("device_name"),
            F.expr(
                "concat('2001:db8:', cast(c_custkey div 10000 as string), '::', cast(c_custkey % 10000 as string), '/127')"
            ).alias("remote_address"),
            F.expr("64512 + c_nationkey").alias("remote_asn"),
            F.expr(
                "case c_custkey % 3 when 0 then cast(array() as array<string>) when 1 then array('EXPORT-TO-IXA') "
                "else array('EXPORT-TO-IXA', 'EXPORT-TO-UFINET') end"
            ).alias("export_policies"),
            F.expr(
                "case when c_custkey % 2 = 0 then array(concat('IMPORT-', c_mktsegment)) else cast(array() as array<string>) end"
            ).alias("import_policies"),
        )
    )


INVENTORY_SQL = """
device AS (
  SELECT s_suppkey AS device_id, s_name AS name, s_nationkey % 16 AS site_id,
         CASE WHEN s_acctbal > 0 THEN concat('10.0.', CAST(s_suppkey // 256 AS VARCHAR), '.', CAST(s_suppkey % 256 AS VARCHAR), '/32')
         END AS primary_ip4 FROM supplier),
interface AS (
  SELECT p_partkey AS interface_id, p_partkey % (SELECT count(*) FROM supplier) AS device_id,
         CASE WHEN p_size % 10 = 0 THEN concat('LoopBack', CAST(p_partkey AS VARCHAR))
              ELSE concat('Ethernet1/0/', CAST(p_partkey AS VARCHAR)) END AS name,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS description, p_size % 7 <> 0 AS enabled,
         CASE WHEN p_size % 2 = 0 THEN 4 ELSE 6 END AS family, p_brand AS manufacturer, p_type AS platform,
         CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'planned' END AS status FROM part),
address AS (
  SELECT o_orderkey AS address_id, o_orderkey % (SELECT count(*) FROM part) AS interface_id,
         CASE WHEN o_orderkey % 2 = 0
              THEN concat('10.', CAST(o_orderkey // 65536 % 256 AS VARCHAR), '.', CAST(o_orderkey // 256 % 256 AS VARCHAR), '.',
                          CAST(o_orderkey % 256 AS VARCHAR), '/', CAST(o_orderkey % 33 AS VARCHAR))
              ELSE concat('2001:db8:', CAST(o_orderkey // 10000 AS VARCHAR), '::', CAST(o_orderkey % 10000 AS VARCHAR), '/64')
         END AS address,
         CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 6 END AS family,
         CAST(o_orderkey % 33 AS INTEGER) AS len FROM orders),
session AS (
  SELECT c_custkey AS session_id, c_custkey % (SELECT count(*) FROM supplier) AS device_id,
         concat('2001:db8:', CAST(c_custkey // 10000 AS VARCHAR), '::', CAST(c_custkey % 10000 AS VARCHAR)) AS peer,
         64512 + c_nationkey AS remote_asn,
         CASE c_custkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['EXPORT-TO-IXA']
              ELSE ['EXPORT-TO-IXA', 'EXPORT-TO-UFINET'] END AS export_policies,
         CASE WHEN c_custkey % 2 = 0 THEN ['IMPORT-' || c_mktsegment] ELSE CAST([] AS VARCHAR[]) END AS import_policies
  FROM customer)"""
MASK_SQL = """concat_ws('.', CAST((m >> 24) & 255 AS VARCHAR), CAST((m >> 16) & 255 AS VARCHAR),
                 CAST((m >> 8) & 255 AS VARCHAR), CAST(m & 255 AS VARCHAR))"""
MASKED_SQL = (
    INVENTORY_SQL
    + """,
masked AS (SELECT *, CAST(4294967296 - pow(2, 32 - len) AS BIGINT) AS m, split_part(address, '/', 1) AS ip FROM address)"""
)

# ------------------------------------------------------------------ projections


@query(
    "prj_18_address_audit",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 8 IN (0, 1, 4) THEN true ELSE false END AS valid,
       CASE c_custkey % 8 WHEN 0 THEN '4' WHEN 1 THEN '6' WHEN 4 THEN '6' END AS version,
       CASE c_custkey % 8 WHEN 0 THEN 'IPV4_VALID' WHEN 1 THEN 'IPV6_VALID' WHEN 4 THEN 'IPV6_VALID' ELSE 'INVALID' END AS message
FROM customer""",
)
def prj_18(spark, sf_dir):
    audited = address_texts(spark, sf_dir).withColumn("version", address.address_family("address"))
    return audited.select(
        "id",
        F.col("version").isNotNull().alias("valid"),
        "version",
        address.audit_code("version").alias("message"),
    )


def address_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed-in addresses, good and bad."""
    low = "cast(c_custkey % 256 as string)"
    return views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr(
            f"""case c_custkey % 8
                when 0 then concat('192.0.2.', {low})
                when 1 then concat('2001:db8::', {low})
                when 2 then concat('192.0.2.', cast(256 + c_custkey % 256 as string))
                when 3 then concat('192.0.02.', {low})
                when 4 then concat('fe80::', {low}, '%eth0')
                when 5 then ''
                when 6 then c_name
                else concat('192.0.2.', {low}, '/24') end"""
        ).alias("address"),
    )


@query(
    "prj_19_address_split",
    f"""WITH {MASKED_SQL}
SELECT address_id, ip, CASE WHEN family = 4 THEN len ELSE 64 END AS prefix_len,
       CASE WHEN family = 4 THEN {MASK_SQL} END AS netmask FROM masked""",
)
def prj_19(spark, sf_dir):
    length = address.prefix_length("address")
    return addresses(spark, sf_dir).select(
        "address_id",
        address.host_part("address").alias("ip"),
        length.alias("prefix_len"),
        F.when(F.col("family") == 4, address.netmask(length)).alias("netmask"),
    )


@query(
    "prj_20_router_id",
    f"""WITH {INVENTORY_SQL}
SELECT device_id, coalesce(split_part(primary_ip4, '/', 1), '0.0.0.0') AS router_id FROM device""",
)
def prj_20(spark, sf_dir):
    return devices(spark, sf_dir).select("device_id", address.router_id("primary_ip4").alias("router_id"))


# ---------------------------------------------------------------------- filters


@query(
    "flt_05_enabled_interfaces",
    f"WITH {INVENTORY_SQL} SELECT interface_id, device_id, name FROM interface WHERE enabled",
)
def flt_05(spark, sf_dir):
    return interfaces(spark, sf_dir).where("enabled").select("interface_id", "device_id", "name")


@query(
    "flt_06_address_family",
    f"WITH {INVENTORY_SQL} SELECT address_id, address, family FROM address WHERE family = 4",
)
def flt_06(spark, sf_dir):
    return addresses(spark, sf_dir).where("family = 4").select("address_id", "address", "family")


@query(
    "flt_07_not_loopback",
    f"WITH {INVENTORY_SQL} SELECT interface_id, name FROM interface WHERE name NOT LIKE '%LoopBack%'",
)
def flt_07(spark, sf_dir):
    return interfaces(spark, sf_dir).where(~F.contains(F.col("name"), F.lit("LoopBack"))).select("interface_id", "name")


@query(
    "flt_08_group_membership",
    "SELECT c_custkey AS host_id, c_name AS host FROM customer WHERE c_nationkey % 2 = 0",
)
def flt_08(spark, sf_dir):
    groups = F.expr(
        "case when c_nationkey % 2 = 0 then array(lower(c_mktsegment), 'huawei') else array(lower(c_mktsegment)) end"
    )
    hosts = views.table(spark, sf_dir, "customer").withColumn("groups", groups)
    return hosts.where(F.array_contains("groups", "huawei")).select(
        F.col("c_custkey").alias("host_id"), F.col("c_name").alias("host")
    )


@query(
    "flt_09_inventory_equality",
    f"""WITH {INVENTORY_SQL}
SELECT interface_id, name FROM interface
WHERE manufacturer = 'Brand#4' AND platform = 'SMALL' AND status = 'active'""",
)
def flt_09(spark, sf_dir):
    wanted = {"manufacturer": "Brand#4", "platform": "SMALL", "status": "active"}
    df = interfaces(spark, sf_dir)
    for column, value in wanted.items():
        df = df.where(F.col(column) == value)
    return df.select("interface_id", "name")


@query(
    "flt_10_family_mismatch",
    """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '4' ELSE '6' END AS peer_version,
       CASE WHEN c_nationkey % 2 = 0 THEN '4' ELSE '6' END AS destination_version
FROM customer
WHERE c_custkey % 8 IN (0, 1, 4)
  AND CASE c_custkey % 8 WHEN 0 THEN 4 ELSE 6 END <> CASE WHEN c_nationkey % 2 = 0 THEN 4 ELSE 6 END""",
)
def flt_10(spark, sf_dir):
    destination = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr("case when c_nationkey % 2 = 0 then '198.51.100.7' else '2001:db8:8888::100' end").alias("destination"),
    )
    pairs = address_texts(spark, sf_dir).join(destination, "id")
    return inventory.family_mismatch(pairs, "address", "destination").select(
        "id", F.col("first_family").alias("peer_version"), F.col("second_family").alias("destination_version")
    )


# ------------------------------------------------------------------------ joins


@query(
    "joi_02_device_relations",
    f"""WITH {INVENTORY_SQL}
SELECT d.device_id, d.name, d.primary_ip4, 'interface' AS kind, i.name AS interface_name, a.address AS address
FROM device d LEFT JOIN interface i ON i.device_id = d.device_id LEFT JOIN address a ON a.interface_id = i.interface_id
UNION ALL
SELECT d.device_id, d.name, d.primary_ip4, 'session', NULL, s.peer || '/127'
FROM device d LEFT JOIN session s ON s.device_id = d.device_id""",
)
def joi_02(spark, sf_dir):
    return inventory.related_rows(
        devices(spark, sf_dir).drop("primary_ip4", "site_id"),
        interfaces(spark, sf_dir).select("interface_id", "device_id", "name"),
        addresses(spark, sf_dir),
        sessions(spark, sf_dir).select("session_id", "device_id", "device_name", "remote_address"),
        primaries(spark, sf_dir),
    )


@query(
    "joi_03_device_sessions",
    f"""WITH {INVENTORY_SQL}
SELECT d.device_id, s.session_id, s.peer || '/127' AS remote_address, s.remote_asn
FROM device d JOIN session s ON s.device_id = d.device_id""",
)
def joi_03(spark, sf_dir):
    out = inventory.device_sessions(devices(spark, sf_dir), sessions(spark, sf_dir))
    return out.select("device_id", "session_id", "remote_address", "remote_asn")


@query(
    "agg_14_device_documents",
    f"""WITH {INVENTORY_SQL},
al AS (SELECT interface_id, list({{'address_id': address_id, 'address': address, 'family': family}} ORDER BY address_id) AS ips
       FROM address GROUP BY interface_id),
il AS (SELECT device_id, list({{'interface_id': i.interface_id, 'address_page': CAST(0 AS BIGINT), 'name': name,
                               'enabled': enabled, 'ip_addresses': coalesce(ips, [])}} ORDER BY i.interface_id) AS interfaces
       FROM interface i LEFT JOIN al ON al.interface_id = i.interface_id GROUP BY device_id),
sl AS (SELECT device_id, list({{'session_id': session_id, 'remote_address': peer || '/127', 'remote_asn': remote_asn}}
                              ORDER BY session_id) AS bgp_sessions FROM session GROUP BY device_id)
SELECT d.device_id, CAST(0 AS BIGINT) AS page, d.name, CAST(to_json(interfaces) AS VARCHAR) AS interfaces,
       CAST(to_json(bgp_sessions) AS VARCHAR) AS bgp_sessions
FROM device d LEFT JOIN il ON il.device_id = d.device_id LEFT JOIN sl ON sl.device_id = d.device_id""",
)
def agg_14(spark, sf_dir):
    return _documents(spark, sf_dir, inventory.PAGE)


def _documents(spark: SparkSession, sf_dir: str, page: int) -> DataFrame:
    documents = inventory.device_documents(
        devices(spark, sf_dir).select("device_id", "name"),
        interfaces(spark, sf_dir),
        addresses(spark, sf_dir),
        sessions(spark, sf_dir),
        page,
    )
    return documents.select(
        "device_id",
        "page",
        "name",
        F.to_json("interfaces").alias("interfaces"),
        F.to_json("bgp_sessions").alias("bgp_sessions"),
    )


# A page size at which most lists of the fixture take several pages.
SMALL_PAGE = 3


@query(
    "agg_14_device_documents_in_pages",
    f"""WITH {INVENTORY_SQL},
an AS (SELECT *, (row_number() OVER (PARTITION BY interface_id ORDER BY address_id) - 1) // {SMALL_PAGE} AS page FROM address),
al AS (SELECT interface_id, page, list({{'address_id': address_id, 'address': address, 'family': family}} ORDER BY address_id) AS ips
       FROM an GROUP BY interface_id, page),
ij AS (SELECT i.*, coalesce(al.page, 0) AS address_page, coalesce(ips, []) AS ips,
              (row_number() OVER (PARTITION BY device_id ORDER BY i.interface_id, al.page) - 1) // {SMALL_PAGE} AS page
       FROM interface i LEFT JOIN al ON al.interface_id = i.interface_id),
il AS (SELECT device_id, page, list({{'interface_id': interface_id, 'address_page': address_page, 'name': name,
                                     'enabled': enabled, 'ip_addresses': ips}} ORDER BY interface_id, address_page) AS interfaces
       FROM ij GROUP BY device_id, page),
sn AS (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY session_id) - 1) // {SMALL_PAGE} AS page FROM session),
sl AS (SELECT device_id, page, list({{'session_id': session_id, 'remote_address': peer || '/127', 'remote_asn': remote_asn}}
                                    ORDER BY session_id) AS bgp_sessions FROM sn GROUP BY device_id, page),
both_lists AS (SELECT device_id, page, interfaces, bgp_sessions FROM il FULL JOIN sl USING (device_id, page))
SELECT d.device_id, coalesce(page, 0) AS page, d.name, CAST(to_json(interfaces) AS VARCHAR) AS interfaces,
       CAST(to_json(bgp_sessions) AS VARCHAR) AS bgp_sessions
FROM device d LEFT JOIN both_lists b ON b.device_id = d.device_id""",
)
def agg_14_pages(spark, sf_dir):
    return _documents(spark, sf_dir, SMALL_PAGE)


# ---------------------------------------------------------------- command rows


@query(
    "arr_03_interface_commands",
    f"""WITH {MASKED_SQL},
e AS (SELECT *, name NOT LIKE '%LoopBack%' AS routed FROM interface WHERE enabled)
SELECT device_id, interface_id, 1 AS step, CAST(0 AS BIGINT) AS item, 'interface ' || name AS text FROM e
UNION ALL SELECT device_id, interface_id, 2, 0, ' description ' || description FROM e WHERE description <> ''
UNION ALL SELECT device_id, e.interface_id, 3, address_id, ' ip address ' || ip || ' ' || {MASK_SQL}
          FROM e JOIN masked a ON a.interface_id = e.interface_id AND a.family = 4
UNION ALL SELECT device_id, interface_id, 4, 0, ' ipv6 enable' FROM e WHERE routed
UNION ALL SELECT device_id, e.interface_id, 5, address_id, ' ipv6 address ' || address
          FROM e JOIN masked a ON a.interface_id = e.interface_id AND a.family = 6 WHERE routed
UNION ALL SELECT device_id, interface_id, 6, 0, ' undo shutdown' FROM e
UNION ALL SELECT device_id, interface_id, 7, 0, 'quit' FROM e""",
)
def arr_03(spark, sf_dir):
    return inventory.interface_commands(interfaces(spark, sf_dir), addresses(spark, sf_dir))


@query(
    "arr_03_session_commands",
    f"""WITH {INVENTORY_SQL},
l AS (SELECT device_id, session_id,
             list_concat([' peer ' || peer || ' as-number ' || CAST(remote_asn AS VARCHAR), ' peer ' || peer || ' enable', ' Y'],
               list_transform(export_policies, lambda p: ' peer ' || peer || ' route-policy ' || p || ' export'),
               [' peer ' || peer || ' advertise-community'],
               list_transform(import_policies, lambda p: ' peer ' || peer || ' route-policy ' || p || ' import')) AS lines
      FROM session)
SELECT device_id, session_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS text
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) x""",
)
def arr_03_sessions(spark, sf_dir):
    return inventory.session_commands(devices(spark, sf_dir), sessions(spark, sf_dir))


@query(
    "arr_03_router_commands",
    f"""WITH {INVENTORY_SQL},
l AS (SELECT device_id, ['system-view', '    sysname ' || name, 'bgp 65000',
                         ' router-id ' || coalesce(split_part(primary_ip4, '/', 1), '0.0.0.0'),
                         'ipv6-family unicast', ' bestroute as-path-ignore'] AS lines FROM device)
SELECT device_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS text
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l) x""",
)
def arr_03_router(spark, sf_dir):
    return inventory.router_commands(devices(spark, sf_dir))


@query(
    "arr_03_device_commands",
    f"""WITH {MASKED_SQL},
e AS (SELECT *, name NOT LIKE '%LoopBack%' AS routed FROM interface WHERE enabled),
s AS (SELECT session.* FROM session JOIN device USING (device_id)),
lines AS (
  SELECT device_id, 1 AS section, 0 AS key, 1 AS step, 0 AS item, 'system-view' AS text FROM device
  UNION ALL SELECT device_id, 1, 0, 2, 0, '    sysname ' || name FROM device
  UNION ALL SELECT device_id, 2, interface_id, 1, 0, 'interface ' || name FROM e
  UNION ALL SELECT device_id, 2, interface_id, 2, 0, ' description ' || description FROM e WHERE description <> ''
  UNION ALL SELECT device_id, 2, e.interface_id, 3, address_id, ' ip address ' || ip || ' ' || {MASK_SQL}
            FROM e JOIN masked a ON a.interface_id = e.interface_id AND a.family = 4
  UNION ALL SELECT device_id, 2, interface_id, 4, 0, ' ipv6 enable' FROM e WHERE routed
  UNION ALL SELECT device_id, 2, e.interface_id, 5, address_id, ' ipv6 address ' || address
            FROM e JOIN masked a ON a.interface_id = e.interface_id AND a.family = 6 WHERE routed
  UNION ALL SELECT device_id, 2, interface_id, 6, 0, ' undo shutdown' FROM e
  UNION ALL SELECT device_id, 2, interface_id, 7, 0, 'quit' FROM e
  UNION ALL SELECT device_id, 5, 0, 1, 0, 'bgp ' || CAST(65000 + site_id AS VARCHAR) FROM device
  UNION ALL SELECT device_id, 5, 0, 2, 0, ' router-id ' || coalesce(split_part(primary_ip4, '/', 1), '0.0.0.0') FROM device
  UNION ALL SELECT device_id, 6, session_id, 0, 0, ' peer ' || peer || ' as-number ' || CAST(remote_asn AS VARCHAR) FROM s
  UNION ALL SELECT device_id, 7, 0, 1, 0, 'ipv6-family unicast' FROM device
  UNION ALL SELECT device_id, 7, 0, 2, 0, ' bestroute as-path-ignore' FROM device
  UNION ALL SELECT device_id, 8, session_id, 1, 0, ' peer ' || peer || ' enable' FROM s
  UNION ALL SELECT device_id, 8, session_id, 2, 0, ' Y' FROM s
  UNION ALL SELECT device_id, 8, session_id, 2 + i, 0, ' peer ' || peer || ' route-policy ' || export_policies[i] || ' export'
            FROM (SELECT *, unnest(range(1, len(export_policies) + 1)) AS i FROM s) x
  UNION ALL SELECT device_id, 8, session_id, 3 + len(export_policies), 0, ' peer ' || peer || ' advertise-community' FROM s
  UNION ALL SELECT device_id, 8, session_id, 3 + len(export_policies) + i, 0,
                   ' peer ' || peer || ' route-policy ' || import_policies[i] || ' import'
            FROM (SELECT *, unnest(range(1, len(import_policies) + 1)) AS i FROM s) x
  UNION ALL SELECT device_id, 10, 0, 1, 0, 'commit' FROM device
  UNION ALL SELECT device_id, 10, 0, 2, 0, 'return' FROM device)
SELECT device_id, CAST(section AS INTEGER) AS section, CAST(key AS BIGINT) AS key, CAST(step AS INTEGER) AS step,
       CAST(item AS BIGINT) AS item, text FROM lines""",
)
def arr_03_device(spark, sf_dir):
    own = devices(spark, sf_dir).withColumn("local_asn", 65000 + F.col("site_id"))
    return inventory.device_commands(
        own, interfaces(spark, sf_dir), addresses(spark, sf_dir), sessions(spark, sf_dir)
    )
