"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from pathmeter import plans
from pathmeter.plans import views
from pathmeter.plans.views import PROVIDERS
from pathmeter.operators import dashboard, failover, smoothing
from pathmeter.sources import tables

SF_DIR = "/root/testdata/sf0.001"
STATIC = [n for n in plans.QUERIES if not n.startswith(("str_", "snk_"))]


def plan(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", STATIC)
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_best_provider_takes_one_shuffle(spark):
    text = physical(smoothing.best_provider(views.measurements(spark, SF_DIR), PROVIDERS))
    assert len(re.findall(r"\bExchange\b", text)) == 1


def test_cycle_rows_take_one_shuffle(spark):
    text = physical(dashboard.wide_figures(views.scored(spark, SF_DIR), PROVIDERS))
    assert len(re.findall(r"\bExchange\b", text)) == 1


def test_row_wise_queries_do_not_shuffle(spark):
    for name in ("prj_07_quality_score", "prj_15_two_digits", "flt_02_relative_time_range", "jsn_01_leaf_paths", "arr_01_prepend_text"):
        assert "Exchange" not in physical(entry.queries()[name](spark, SF_DIR)), name


def test_time_range_reaches_the_scan(spark):
    text = physical(entry.queries()["flt_02_relative_time_range"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,2024-01-15T11:45\).*LessThanOrEqual\(ts,2024-01-15T12:00\)", text)


def test_day_range_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_telemetry(views.scored(spark, SF_DIR), path)
    text = physical(tables.read_telemetry(spark, path, "2024-01-10 06:00:00", "2024-01-12 18:00:00").select("score"))
    assert re.search(r"PartitionFilters: \[.*dt.*2024-01-10.*dt.*2024-01-12", text)
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,score:double>", text)


def test_only_needed_columns_are_read(spark):
    text = physical(entry.queries()["prj_09_healthy"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in text


def test_fold_reads_its_input_once(spark):
    """The measurements go into the stored chunks; what follows reads only those."""
    text = plan(failover.fold(views.measurements(spark, SF_DIR), PROVIDERS))
    assert "events.parquet" not in text and "chunks-" in text
