"""From a captured report to a flat measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathmeter import schemas

CORRUPT = "_corrupt"


def parse_reports(df: DataFrame, body: str = "body") -> DataFrame:
    """Parse the report text; ``report`` is null where the text is no valid JSON.

    The parse sits in a generator so that it runs once per row: as a plain
    column it would be copied into every later filter that looks at it.
    """
    schema = T.StructType([*schemas.REPORT_BODY.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = [c for c in df.columns if c != "report"]
    return (
        df.select(*kept, F.inline(F.array(parsed)))
        .withColumn("report", F.when(F.col(CORRUPT).isNull(), F.col("report")))
        .drop(CORRUPT)
    )


def final_hop(hubs: Column | str = "report.hubs") -> Column:
    """The hop whose number equals the number of hops; of several the last."""
    hubs = F.col(hubs) if isinstance(hubs, str) else hubs
    return F.try_element_at(F.filter(hubs, lambda h: h["count"] == F.size(hubs)), F.lit(-1))


def peer_hop(hubs: Column | str = "report.hubs", peer_ip: Column | str = "peer_ip") -> Column:
    """The last hop with the peer's address."""
    return _peer_hops(hubs, peer_ip, -1)


def first_peer_hop(hubs: Column | str = "report.hubs", peer_ip: Column | str = "peer_ip") -> Column:
    """The first hop with the peer's address (the check tool stops there)."""
    return _peer_hops(hubs, peer_ip, 1)


def _peer_hops(hubs: Column | str, peer_ip: Column | str, which: int) -> Column:
    hubs = F.col(hubs) if isinstance(hubs, str) else hubs
    peer_ip = F.col(peer_ip) if isinstance(peer_ip, str) else peer_ip
    return F.try_element_at(F.filter(hubs, lambda h: h["host"] == peer_ip), F.lit(which))


def extract_metrics(
    df: DataFrame, loss_mode: str = "end_to_end", defaults: str = "engine"
) -> DataFrame:
    """Six metrics and ``failed`` from ``report`` and ``peer_ip``.

    ``loss_mode='end_to_end'`` gives the peer the destination's loss, since a
    hop on the way may only be limiting its replies; ``'own_hop'`` keeps the
    peer's own. Missing fields become inf/100/0 (``engine``) or 0
    (``calibrator``). A JSON null counts as missing.
    """
    avg, loss = (float("inf"), 100.0) if defaults == "engine" else (0.0, 0.0)
    hops = df.withColumns({"_peer": peer_hop(), "_dns": final_hop()})
    failed = F.col("_peer").isNull() | F.col("_dns").isNull()

    def field(hop: str, name: str, default: float) -> Column:
        return F.when(~failed, F.coalesce(F.col(hop)[name], F.lit(default)))

    dns_loss = field("_dns", "Loss%", loss)
    return hops.withColumns(
        {
            "failed": failed,
            "peer_avg": field("_peer", "Avg", avg),
            "peer_loss": dns_loss if loss_mode == "end_to_end" else field("_peer", "Loss%", loss),
            "dns_avg": field("_dns", "Avg", avg),
            "dns_loss": dns_loss,
            "peer_stddev": field("_peer", "StDev", 0.0),
            "dns_stddev": field("_dns", "StDev", 0.0),
        }
    ).drop("_peer", "_dns")


def with_provider(probes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach order, addresses and family of the provider; unknown ones keep nulls.

    The dimension has one row per site and provider and is left to Spark's size
    check: broadcast while small, else a shuffle join with skew splitting.
    """
    return probes.join(dimension, ["site_id", "provider"], "left")


def hop_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hop with its figures, the hop count and the trace header."""
    return df.select(
        *keys,
        F.col("report.mtr.src").alias("src"),
        F.col("report.mtr.dst").alias("dst"),
        F.col("report.mtr.tests").alias("tests"),
        F.size("report.hubs").alias("n_hops"),
        F.inline("report.hubs"),
    ).withColumnsRenamed({"Loss%": "loss", "Avg": "avg", "StDev": "stdev"})


def ping_average(output: Column | str, returncode: Column | str) -> Column:
    """Average latency from captured ping text, infinity when there is none.

    The first line holding ``avg`` is cut at ``/`` and its fifth part taken.
    """
    output = F.col(output) if isinstance(output, str) else output
    returncode = F.col(returncode) if isinstance(returncode, str) else returncode
    line = F.get(F.filter(F.split(output, "\n"), lambda x: F.contains(x, F.lit("avg"))), F.lit(0))
    token = F.trim(F.get(F.split(line, "/"), F.lit(4)))
    # A bare cast would also take Java forms such as "1.5f".
    number = F.when(
        token.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        token.try_cast("double"),
    )
    return F.coalesce(F.when(returncode == 0, number), F.lit(float("inf")))
