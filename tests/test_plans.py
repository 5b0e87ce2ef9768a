"""Properties the plans must keep."""

import os

import pytest

from tidewatt.plans.registry import load_catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load_catalog()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plan_text(spark, name):
    return CATALOG[name].plan(spark, FOLDER)._jdf.queryExecution().toString()


SAMPLE = ["lag_week_exact", "hour_spine", "holiday_flag", "wavg_strict", "sheet_to_load", "pivot_last", "metrics_overlap", "error_histogram", "lag_missing_reason", "panel_audit", "lag_rows_24", "month_coverage"]


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_join_and_no_python(spark, name):
    text = plan_text(spark, name).split("== Physical Plan ==")[1]
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


def test_scans_read_only_needed_columns(spark):
    text = plan_text(spark, "forecast_metrics")
    assert "l_comment" not in text.split("ReadSchema")[1] and "l_orderkey" not in text.split("ReadSchema:")[-1]
    assert "props" not in plan_text(spark, "coverage_by_region").split("ReadSchema:")[-1]


def test_ranked_dedup_limits_before_the_shuffle(spark):
    text = plan_text(spark, "dedup_last").split("== Physical Plan ==")[1]
    assert text.count("WindowGroupLimit") == 2


def test_pivot_and_lag_hash_aggregate(spark):
    assert "SortAggregate" not in plan_text(spark, "pivot_last").split("== Physical Plan ==")[1]
    assert "SortAggregate" not in plan_text(spark, "lag_week_exact").split("== Physical Plan ==")[1]
