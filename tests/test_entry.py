"""Driver contract: entry() runs; every oracle key is a query; a sample of queries matches
its DuckDB SQL on sf0.001; the streaming query equals the batch result."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from kiln.plans.tables import TABLES

SAMPLE = ["flagship_daily_naive_forecast", "c12_outliers_events", "c14_clean_table", "d6_impute_dates_mean",
          "d11_regular_daily", "e7_lags_single_series", "p2_stratified_labels", "p5_sequence_windows",
          "x3_roc_auc", "x14_acf", "g2_profile", "g5_kendall", "r3_validate_runs", "streaming_row_local_clean"]


def _norm(v):
    import math
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "mse" in df.columns


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a = _rows(entry.queries()[name](spark, SF).toPandas())
    b = _rows(con.execute(entry.oracle_sql()[name]).df())
    assert a == b


def test_missing_days_stay_in_the_table(spark):
    """The planted gaps are NULL dates, not dropped rows."""
    from kiln.plans.queries import irregular_daily, table
    days = table(spark, SF, "lineitem").select("l_returnflag", "l_shipdate").distinct()
    got = irregular_daily(spark, SF)
    gaps = days.where("dayofmonth(l_shipdate) % 9 = 0").count()
    assert got.count() == days.count() and got.where("day is null").count() == gaps > 0


@pytest.mark.parametrize("name", ["d11_regular_irregular", "d13_reindex_daily"])
def test_missing_days_match_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(con.execute(entry.oracle_sql()[name]).df())
