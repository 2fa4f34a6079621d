"""Captured probe reports built from the probe view, and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmeter import params as P
from pathmeter import session
from pathmeter.functions import probes, scoring
from pathmeter.plans import views
from pathmeter.plans.registry import query
from pathmeter.sources import providers as provider_source
from pathmeter.sources import reports as report_source

KEYS = ["site_id", "provider", "cycle"]
ADDRESS_SQL = """
CASE provider_ord WHEN 0 THEN '2001:db8:8888::100' ELSE '2001:db8:4444::100' END AS destination,
CASE provider_ord WHEN 0 THEN '2001:db8:ffaa::255' ELSE '2001:db8:ffac::255' END AS peer_ip"""
# Rows with text that parses (k = 99 is cut short) and their number of hops.
HOPS_SQL = (
    views.PROBE_SQL
    + f""",
hops AS (SELECT *, CASE WHEN k = 98 THEN 2 WHEN k % 10 = 3 THEN 4 ELSE 3 END AS n_hops, {ADDRESS_SQL}
         FROM probe)"""
)


def _hub(count: Column, host: Column, loss: Column, avg: Column, stdev: Column) -> Column:
    return F.struct(
        count.cast("int").alias("count"),
        host.alias("host"),
        loss.alias("Loss%"),
        avg.alias("Avg"),
        stdev.alias("StDev"),
    )


def captured(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Report text per site, provider and cycle.

    k = 98 has no peer hop and k = 99 is cut short; k % 10 = 3 has an earlier
    hop with the peer's address, k % 10 = 7 a first hop bearing the last number.
    With ``gaps`` the destination hop of k % 25 = 5 lacks its figures.
    """
    k = F.col("k")
    rows = views.probe(spark, sf_dir).withColumns(
        {
            name: F.get(F.array(*[F.lit(entry[i]) for entry in P.DEFAULT_PROVIDERS]), F.col("provider_ord"))
            for name, i in (("destination", 2), ("peer_ip", 3))
        }
    )
    n = F.when(k == 98, 2).when(k % 10 == 3, 4).otherwise(3)
    decoy = F.when((k % 10 == 7) & (k != 98), n).otherwise(F.lit(1))
    gone = (k % 25 == 5) if gaps else F.lit(False)
    null = F.lit(None).cast("double")
    gateway = _hub(decoy, F.lit("10.0.0.1"), F.lit(0.0), F.lit(0.5), F.lit(0.125))
    early = _hub(F.lit(2), F.col("peer_ip"), F.lit(0.0), F.lit(0.25), F.lit(0.0625))
    peer = _hub(n - 1, F.col("peer_ip"), (k % 3) * 5.0, F.col("peer_avg"), F.col("peer_stddev"))
    dest = _hub(
        n,
        F.col("destination"),
        F.when(gone, null).otherwise(F.col("loss")),
        F.when(gone, null).otherwise(F.col("dns_avg")),
        F.when(gone, null).otherwise(F.col("dns_stddev")),
    )
    hubs = (
        F.when(k == 98, F.array(gateway, dest))
        .when(k % 10 == 3, F.array(gateway, early, peer, dest))
        .otherwise(F.array(gateway, peer, dest))
    )
    trace = F.struct(
        F.concat(F.lit("site-"), F.col("site_id").cast("string")).alias("src"),
        F.col("destination").alias("dst"),
        F.lit(5).alias("tests"),
    )
    text = F.to_json(F.struct(F.struct(trace.alias("mtr"), hubs.alias("hubs")).alias("report")))
    cut_short = F.expr("left(_text, length(_text) - 3)")
    return (
        rows.withColumn("_text", text)
        .withColumn("body", F.when(k == 99, cut_short).otherwise(F.col("_text")))
        .select("site_id", "provider", "cycle", "ts", "body")
    )


def parsed(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Captured text joined with the provider dimension and parsed."""
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    return probes.parse_reports(probes.with_provider(captured(spark, sf_dir, gaps), dimension))


def _hop_columns(hop: Column) -> list[Column]:
    return [
        hop["count"].alias("hop_no"),
        hop["host"].alias("host"),
        hop["Loss%"].alias("loss"),
        hop["Avg"].alias("avg_ms"),
        hop["StDev"].alias("stdev_ms"),
    ]


@query(
    "src_01_probe_reports",
    f"""WITH {views.MEAS_SQL}
SELECT site_id, provider, cycle, ts, failed, peer_avg, peer_loss, dns_avg, dns_loss, peer_stddev, dns_stddev
FROM meas""",
)
def src_01(spark, sf_dir):
    """Write captured reports as JSON lines and read them back as measurements."""
    path = session.scratch_dir(spark, "reports")
    captured(spark, sf_dir).write.option("timestampNTZFormat", report_source.TS_FORMAT).json(path)
    read = report_source.read_reports(spark, path)
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    flat = probes.extract_metrics(probes.with_provider(read, dimension))
    return scoring.impute_failed(flat).select(
        *KEYS, "ts", "failed", "peer_avg", "peer_loss", "dns_avg", "dns_loss", "peer_stddev", "dns_stddev"
    )


@query(
    "prj_01_final_hop",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, n_hops AS hop_no, destination AS host, loss, dns_avg AS avg_ms, dns_stddev AS stdev_ms
FROM hops WHERE k < 99""",
)
def prj_01(spark, sf_dir):
    df = parsed(spark, sf_dir).withColumn("hop", probes.final_hop())
    return df.where("hop is not null").select(*KEYS, *_hop_columns(F.col("hop")))


@query(
    "prj_02_peer_hop",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, n_hops - 1 AS hop_no, peer_ip AS host, (k % 3) * 5.0::DOUBLE AS loss,
       peer_avg AS avg_ms, peer_stddev AS stdev_ms
FROM hops WHERE k < 98""",
)
def prj_02(spark, sf_dir):
    df = parsed(spark, sf_dir).withColumn("hop", probes.peer_hop())
    return df.where("hop is not null").select(*KEYS, *_hop_columns(F.col("hop")))


@query(
    "prj_03_missing_hop_rejection",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, k = 99 AS unreadable, failed FROM hops""",
)
def prj_03(spark, sf_dir):
    df = probes.extract_metrics(parsed(spark, sf_dir))
    return df.select(*KEYS, F.col("report").isNull().alias("unreadable"), "failed")


@query(
    "prj_04_field_defaults",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, peer_avg,
       CASE WHEN k % 25 = 5 THEN 100.0::DOUBLE ELSE loss END AS dns_loss,
       CASE WHEN k % 25 = 5 THEN 'Infinity'::DOUBLE ELSE dns_avg END AS dns_avg,
       CASE WHEN k % 25 = 5 THEN 0.0::DOUBLE ELSE dns_stddev END AS dns_stddev,
       CASE WHEN k % 25 = 5 THEN 0.0::DOUBLE ELSE loss END AS calibrator_dns_loss,
       CASE WHEN k % 25 = 5 THEN 0.0::DOUBLE ELSE dns_avg END AS calibrator_dns_avg
FROM hops WHERE k < 98""",
)
def prj_04(spark, sf_dir):
    df = parsed(spark, sf_dir, gaps=True)
    engine = probes.extract_metrics(df).where("not failed")
    both = probes.extract_metrics(
        engine.withColumnsRenamed({m: f"e_{m}" for m in ("peer_avg", "dns_loss", "dns_avg", "dns_stddev")}),
        defaults="calibrator",
    )
    return both.select(
        *KEYS,
        F.col("e_peer_avg").alias("peer_avg"),
        F.col("e_dns_loss").alias("dns_loss"),
        F.col("e_dns_avg").alias("dns_avg"),
        F.col("e_dns_stddev").alias("dns_stddev"),
        F.col("dns_loss").alias("calibrator_dns_loss"),
        F.col("dns_avg").alias("calibrator_dns_avg"),
    )


@query(
    "prj_05_end_to_end_loss",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, loss AS peer_loss, loss AS dns_loss FROM hops WHERE k < 98""",
)
def prj_05(spark, sf_dir):
    df = probes.extract_metrics(parsed(spark, sf_dir))
    return df.where("not failed").select(*KEYS, "peer_loss", "dns_loss")


@query(
    "prj_06_own_hop_loss",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, (k % 3) * 5.0::DOUBLE AS peer_loss, loss AS dns_loss FROM hops WHERE k < 98""",
)
def prj_06(spark, sf_dir):
    df = probes.extract_metrics(parsed(spark, sf_dir), loss_mode="own_hop")
    return df.where("not failed").select(*KEYS, "peer_loss", "dns_loss")


@query(
    "prj_23_hop_path",
    f"""WITH {HOPS_SQL},
lines AS (
  SELECT site_id, provider, cycle, destination, n_hops,
         CASE WHEN k % 10 = 7 AND k <> 98 THEN n_hops ELSE 1 END AS "count", '10.0.0.1' AS host,
         0.0::DOUBLE AS loss, 0.5::DOUBLE AS "avg", 0.125::DOUBLE AS stdev FROM hops WHERE k < 99
  UNION ALL
  SELECT site_id, provider, cycle, destination, n_hops, 2, peer_ip, 0.0::DOUBLE, 0.25::DOUBLE, 0.0625::DOUBLE
  FROM hops WHERE k < 98 AND k % 10 = 3
  UNION ALL
  SELECT site_id, provider, cycle, destination, n_hops, n_hops - 1, peer_ip, (k % 3) * 5.0::DOUBLE, peer_avg, peer_stddev
  FROM hops WHERE k < 98
  UNION ALL
  SELECT site_id, provider, cycle, destination, n_hops, n_hops, destination, loss, dns_avg, dns_stddev
  FROM hops WHERE k < 99)
SELECT site_id, provider, cycle, concat('site-', CAST(site_id AS VARCHAR)) AS src, destination AS dst, 5 AS tests,
       n_hops, "count", host, loss, "avg", stdev FROM lines""",
)
def prj_23(spark, sf_dir):
    return probes.hop_rows(parsed(spark, sf_dir), KEYS)


@query(
    "prj_24_peer_found",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, cycle, k < 98 AS peer_found,
       CASE WHEN k >= 98 THEN NULL WHEN k % 10 = 3 THEN 2 ELSE n_hops - 1 END AS hop_no,
       CASE WHEN k >= 98 THEN NULL WHEN k % 10 = 3 THEN 0.25::DOUBLE ELSE peer_avg END AS avg_ms
FROM hops""",
)
def prj_24(spark, sf_dir):
    df = parsed(spark, sf_dir).withColumn("hop", probes.first_peer_hop())
    return df.select(
        *KEYS,
        F.col("hop").isNotNull().alias("peer_found"),
        F.col("hop.count").alias("hop_no"),
        F.col("hop.Avg").alias("avg_ms"),
    )


@query(
    "joi_01_probes_with_providers",
    f"""WITH {HOPS_SQL}
SELECT site_id, CASE WHEN k % 20 = 4 THEN 'PROVIDER9' ELSE provider END AS provider, cycle,
       CASE WHEN k % 20 <> 4 THEN provider_ord END AS provider_ord,
       CASE WHEN k % 20 <> 4 THEN peer_ip END AS peer_ip,
       k % 20 = 4 OR failed AS failed
FROM hops""",
)
def joi_01(spark, sf_dir):
    """Every probe meets its provider; an unknown provider is a failed measurement."""
    k = F.col("k")
    rows = views.probe(spark, sf_dir).drop("provider_ord").withColumn(
        "provider", F.when(k % 20 == 4, F.lit("PROVIDER9")).otherwise(F.col("provider"))
    )
    dimension = provider_source.default_dimension(views.sites(spark, sf_dir))
    joined = probes.with_provider(rows, dimension)
    return joined.select(
        *KEYS, "provider_ord", "peer_ip", (F.col("peer_ip").isNull() | F.col("failed")).alias("failed")
    )


@query(
    "agg_18_report_counts",
    f"""WITH {HOPS_SQL}
SELECT site_id, provider, count(*) AS n_reports, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
       CAST(sum(CASE WHEN k < 99 THEN n_hops ELSE 0 END) AS BIGINT) AS n_hops
FROM hops GROUP BY ALL""",
)
def agg_18(spark, sf_dir):
    df = probes.extract_metrics(parsed(spark, sf_dir))
    return df.groupBy("site_id", "provider").agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.count_if("failed").alias("n_failed"),
        F.sum(F.coalesce(F.size("report.hubs"), F.lit(0))).alias("n_hops"),
    )


# ------------------------------------------------------------------ ping output


def ping_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured ping text: k >= 98 ended with an error, k % 25 = 5 has no summary
    line and k % 25 = 6 a broken one."""
    k = F.col("k")
    figure = F.col("peer_avg").cast("string")
    head = F.concat(F.lit("PING "), F.col("provider"), F.lit(" 56 data bytes\n"))
    summary = (
        F.when(k % 25 == 5, F.lit("3 packets transmitted, 0 received\n"))
        .when(k % 25 == 6, F.lit("rtt min/avg/max/mdev = 0.1/fast/9/0.2 ms\n"))
        .otherwise(F.concat(F.lit("rtt min/avg/max/mdev = 0.1/"), figure, F.lit("/999.5/0.2 ms\n")))
    )
    return views.probe(spark, sf_dir).select(
        "site_id",
        "provider",
        "cycle",
        F.when(k >= 98, 1).otherwise(0).alias("returncode"),
        F.concat(head, F.lit("3 packets transmitted, 3 received\n"), summary).alias("output"),
    )


@query(
    "src_02_ping_summary",
    f"""WITH {views.PROBE_SQL}
SELECT site_id, provider, cycle,
       CASE WHEN k >= 98 OR k % 25 IN (5, 6) THEN 'Infinity'::DOUBLE ELSE peer_avg END AS latency
FROM probe""",
)
def src_02(spark, sf_dir):
    path = session.scratch_dir(spark, "ping")
    ping_outputs(spark, sf_dir).write.parquet(path)
    return report_source.read_ping(spark, path).select(*KEYS, "latency")
