import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from measured import score
from pyspark.sql import functions as F

from pathmeter import params as P
from pathmeter.functions import bands, scoring, steps

CASES = [
    ((5, 0, 10, 0, 1, 1), 7.5),
    ((20, 10, 50, 0, 10, 10), 1039.0),
    ((999, 100, 999, 100, 0, 0), 20999.0),
]


def frame(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{m} double" for m in P.METRICS))


def test_score_examples(spark):
    got = [r.score for r in scoring.with_score(frame(spark, [c for c, _ in CASES])).collect()]
    assert got == pytest.approx([want for _, want in CASES])
    assert steps.penalty_score() == 20999.0


def test_health_limits(spark):
    rows = [(5, 19.9, 5, 19.9, 0, 0), (5, 20, 5, 0, 0, 0), (25, 0, 5, 0, 0, 0), (12, 0, 1, 0, 0, 0)]
    t = P.Thresholds()
    got = frame(spark, rows).select(
        scoring.is_healthy(),
        scoring.is_strictly_healthy(F.lit(t.peer_critical), F.lit(t.dns_critical)),
        scoring.has_latency_warning(F.lit(t.peer_warning), F.lit(t.dns_warning)),
        scoring.has_latency_critical(F.lit(t.peer_critical), F.lit(t.dns_critical)),
        scoring.has_packet_loss(),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, False, False, False, True),
        (False, False, False, False, True),
        (True, False, True, True, False),
        (True, True, True, False, False),
    ]


def test_cut_and_labels(spark):
    df = spark.createDataFrame([(1.005, "My Link"), (float("inf"), None)], "x double, s string")
    got = df.select(
        scoring.cut("x").alias("x"), scoring.provider_key("s").alias("k"), scoring.provider_prefix("s").alias("p"),
        scoring.ip_version_label(F.lit(None).cast("string")).alias("v"), bands.band("score", "x").alias("b"),
    ).collect()
    assert tuple(got[0])[1:] == ("MY_LINK", "my link", "IPv?", "green") and abs(got[0].x - 1.0) <= 0.01
    assert got[1].x == float("inf") and got[1].b == "red"


positive = st.floats(0, 1000)


@settings(max_examples=200, deadline=None)
@given(st.tuples(*[positive] * 6), st.integers(0, 5), positive)
def test_score_never_falls_when_an_input_grows(values, which, more):
    m = dict(zip(P.METRICS, values))
    worse = dict(m)
    worse[P.METRICS[which]] += more
    assert score(worse) >= score(m)
