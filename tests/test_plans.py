"""Plan properties that matter at scale: no cartesian products, nested-loop joins or
row-at-a-time Python UDFs; literal bounds reach the Parquet scan."""

import pytest

import __spark_entry__ as entry
from conftest import SF

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["flagship_daily_naive_forecast", "p2_stratified_lineitem", "d6_impute_dates_mean",
                                  "x3_roc_auc", "g5_kendall", "p5_sequence_windows"])
def test_no_unscalable_operators(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert not [b for b in BAD if b in plan]


def test_iqr_bounds_pushed_down(spark):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        entry.queries()["c12_outliers_lineitem"](spark, SF).explain("formatted")
    pushed = [line for line in buf.getvalue().splitlines() if "PushedFilters" in line]
    assert pushed and "GreaterThanOrEqual(l_orderkey" in pushed[0] and "LessThanOrEqual(l_tax" in pushed[0]
