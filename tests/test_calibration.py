from datetime import datetime

import pytest

from pathmeter import schemas
from pathmeter.operators import calibration
from pathmeter.sources import providers, tables

COLUMNS = "site_id bigint, provider string, provider_ord int, " + ", ".join(
    f"{c} double"
    for c in ("peer_latency_avg", "dns_latency_avg", "peer_jitter_avg", "dns_jitter_avg", "peer_jitter_max", "peer_loss_max", "dns_loss_max")
) + ", measurement_count bigint"


def metrics(spark, sites):
    rows = []
    for site, (peer, dns, jitter, top) in sites.items():
        for i, (p, d, j) in enumerate(zip(peer, dns, jitter)):
            rows.append((site, f"P{i}", i, float(p), float(d), float(j), 0.0, float(top), 0.0, 0.0, 10))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def config(spark):
    sites = {0: ([5, 6.25], [9, 12], [0.4, 0.6], 1), 1: ([20, 60], [40, 90], [4, 8], 12), 2: ([7], [9], [0.1], 0.5)}
    return {r.site_id: r for r in calibration.recommendations(calibration.calibrated_config(metrics(spark, sites))).collect()}


def test_golden_thresholds(config):
    a, b = config[0], config[1]
    assert (a.peer_warning, a.peer_critical, a.dns_warning, a.dns_critical) == (12, 25, 30, 60)
    assert (a.switch_margin, a.avg_latency, a.cycle_interval, a.network_class) == (5, 8.0625, 30, "excellent")
    assert (a.class_latency, a.avg_peer_jitter) == (9.125, 0.5)
    assert (b.peer_warning, b.peer_critical, b.dns_warning, b.dns_critical) == (120, 240, 225, 450)
    assert (b.switch_margin, b.avg_latency, b.cycle_interval, b.network_class) == (10, 52.5, 60, "acceptable")
    assert (b.probe_count, b.probe_interval, a.probe_count, a.probe_interval) == (3, 1.0, 5, 0.5)


def test_margin_bounds_and_advice(config):
    assert config[2].switch_margin == 3 and config[2].peer_diff == 0
    assert list(config[0].recommendations) == ["NO_PACKET_LOSS"]
    assert list(config[1].recommendations) == ["HIGH_LATENCY", "LARGE_DIFFERENCE", "NO_PACKET_LOSS"]
    assert list(config[2].recommendations) == ["SIMILAR_PROVIDERS", "NO_PACKET_LOSS"]


def measurement(site, provider, order, cycle, failed, x):
    return (site, cycle, provider, order, datetime(2024, 1, 1), failed, x, 1.0, x, 1.0, 0.5, 0.5)


def test_metrics_of_failed_and_single_cycles(spark):
    rows = [measurement(0, "A", 0, c, True, 5.0) for c in range(4)] + [measurement(0, "B", 1, 0, False, 8.0)]
    df = spark.createDataFrame(rows, schemas.MEASUREMENT)
    got = {r.provider: r for r in calibration.provider_metrics(df).collect()}
    assert (got["A"].success_rate, got["A"].peer_latency_avg, got["A"].measurement_count) == (0.0, 0.0, 0)
    assert (got["B"].success_rate, got["B"].peer_latency_std, got["B"].peer_loss_max) == (100.0, 0.0, 1.0)
    spread = calibration.site_baseline(calibration.provider_metrics(df)).first()
    kept = calibration.site_baseline(calibration.provider_metrics(df), exclude_failed=True).first()
    assert (spread.peer_diff, kept.peer_diff) == (8.0, 0.0)


def test_comparison_and_fastest(spark):
    m = metrics(spark, {0: ([5, 5, 30], [9, 9, 50], [0, 0, 0], 0)})
    pairs = {(r.provider_a, r.provider_b): r.comparison for r in calibration.compare_providers(m).collect()}
    assert pairs == {("P0", "P1"): "similar", ("P0", "P2"): "significant", ("P1", "P2"): "significant"}
    assert calibration.fastest_provider(m).first().best_provider == "P0"
    assert {(r.provider, r.slower_by) for r in calibration.behind_fastest(m).collect()} == {("P1", 0.0), ("P2", 25.0)}


def test_stored_settings_fall_back(spark, tmp_path):
    config = calibration.calibrated_config(metrics(spark, {1: ([20, 60], [40, 90], [4, 8], 12)}))
    tables.write_calibrated(config, str(tmp_path / "c"))
    sites = spark.createDataFrame([(1,), (2,)], "site_id bigint")
    got = {r.site_id: r for r in providers.thresholds_or_default(sites, tables.read_calibrated(spark, str(tmp_path / "c"))).collect()}
    assert (got[1].peer_warning, got[2].peer_warning, got[2].switch_margin) == (120, 12, 5)


def test_a_calibration_keeps_the_other_sites(spark, tmp_path):
    path = str(tmp_path / "c")
    first = calibration.calibrated_config(metrics(spark, {1: ([20, 60], [40, 90], [4, 8], 12), 2: ([20, 60], [40, 90], [4, 8], 12)}))
    tables.write_calibrated(first, path, "1")
    tables.write_calibrated(calibration.calibrated_config(metrics(spark, {2: ([5, 6.25], [9, 12], [0.4, 0.6], 1)})), path, "2")
    stored = tables.read_calibrated(spark, path)
    assert stored.columns == first.columns
    got = {r.site_id: r.peer_warning for r in stored.collect()}
    assert got == {1: 120, 2: 12}
