"""Schemas of the stored and captured data."""

from __future__ import annotations

from pyspark.sql import types as T

HUB = T.StructType(
    [
        T.StructField("count", T.IntegerType()),
        T.StructField("host", T.StringType()),
        T.StructField("Loss%", T.DoubleType()),
        T.StructField("Avg", T.DoubleType()),
        T.StructField("StDev", T.DoubleType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField(
            "mtr",
            T.StructType(
                [
                    T.StructField("src", T.StringType()),
                    T.StructField("dst", T.StringType()),
                    T.StructField("tests", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("hubs", T.ArrayType(HUB)),
    ]
)

# Text of one captured report: {"report": {...}}.
REPORT_BODY = T.StructType([T.StructField("report", REPORT)])

# Our envelope round one captured report.
PROBE_ENVELOPE = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("provider", T.StringType()),
        T.StructField("cycle", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("body", T.StringType()),
    ]
)

MEASUREMENT = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("cycle", T.LongType()),
        T.StructField("provider", T.StringType()),
        T.StructField("provider_ord", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("peer_avg", T.DoubleType()),
        T.StructField("peer_loss", T.DoubleType()),
        T.StructField("dns_avg", T.DoubleType()),
        T.StructField("dns_loss", T.DoubleType()),
        T.StructField("peer_stddev", T.DoubleType()),
        T.StructField("dns_stddev", T.DoubleType()),
    ]
)

PROVIDER = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("provider", T.StringType()),
        T.StructField("provider_ord", T.IntegerType()),
        T.StructField("destination", T.StringType()),
        T.StructField("peer_ip", T.StringType()),
        T.StructField("ip_version", T.StringType()),
    ]
)

THRESHOLDS = T.StructType(
    [T.StructField("site_id", T.LongType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in ("peer_warning", "peer_critical", "dns_warning", "dns_critical", "switch_margin")
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

POLICY_CONTEXT = "map<string,struct<as_path_prepend_count:int,local_preference:int>>"
