"""Every registered query against its SQL in DuckDB."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from pathmeter import plans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = plans.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert oracle.difference(entry.queries()[name](spark, SF_DIR), con, SQL[name]) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["site_id", "cycle", "best_provider", "best_score"]
    assert df.count() > 0


def test_every_surveyed_operator_has_a_query():
    counts = {"src": 7, "snk": 3, "prj": 26, "joi": 11, "agg": 18, "win": 7, "srt": 4, "set": 2, "jsn": 4, "arr": 4, "str": 8}
    wanted = {f"{k}_{i:02d}" for k, n in counts.items() for i in range(1, n + 1)}
    wanted |= {f"flt_{i:02d}" for i in (1, 2, 4, 5, 6, 7, 8, 9, 10)}
    assert wanted == {"_".join(n.split("_")[:2]) for n in plans.QUERIES}
