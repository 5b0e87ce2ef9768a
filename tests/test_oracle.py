"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from tests.compare import differences, oracle
from tidewatt.plans.registry import load_catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load_catalog()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is not None])
def test_query_equals_its_sql(spark, con, name):
    query = CATALOG[name]
    assert differences(query.plan(spark, FOLDER), con, query.sql) is None


@pytest.mark.parametrize("name", ["fit_linear", "fit_ridge", "fit_seasonal_by_region", "score_next_day"])
def test_model_query_scores_rows(spark, name):
    rows = CATALOG[name].plan(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r["predicted_load_mw"] is not None for r in rows)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
