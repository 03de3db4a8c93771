"""Cleaning operators on the reference's fixture shapes (regenerated, not copied)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kiln.operators import clean


def test_trim_blank_and_names(spark):
    df = spark.createDataFrame([("  a ", "1", 1.5), ("b", "2", None), ("   ", "3", 2.0)], "` col1 ` string, col2 string, ` col3 ` double")
    x = clean.trim_columns(df)
    assert x.columns == ["col1", "col2", "col3"]
    x = clean.blank_to_null(clean.trim_cells(x))
    assert [r.col1 for r in x.orderBy("col2").collect()] == ["a", "b", None]


def test_numeric_text_conversion(spark):
    df = spark.createDataFrame([("123", "123", "x", "12.3"), ("456", "abc", "y", "45.6"), ("789", "456", "z", "78.9")],
                               "numeric_str string, mixed_col string, regular_col string, decimal_str string")
    x, conv = clean.cast_numeric_columns(df)
    assert set(conv) == {"numeric_str", "decimal_str"}
    types = dict(x.dtypes)
    assert types["numeric_str"] == "bigint" and types["decimal_str"] == "double"
    assert types["mixed_col"] == "string"
    neg = spark.createDataFrame([("-1",), ("2",)], "a string")
    assert clean.cast_numeric_columns(neg)[1] == []


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "col1 int, col2 string")
    assert clean.drop_duplicates(df).count() == 3
    assert clean.duplicates_report(df) == 1


def test_numeric_fill_strategies(spark):
    df = spark.createDataFrame([(1, 1.5), (2, None), (None, 3.5), (4, 4.5)], "col1 int, col2 double")
    x, rep = clean.fill_numeric(df, "mean")
    got = x.orderBy(F.col("col2")).collect()
    assert rep["numeric_missing_before"] == {"col1": 1, "col2": 1}
    assert abs(rep["numeric_imputations"]["col1"]["fill_value"] - 7 / 3) < 1e-12
    assert [round(r.col2, 9) for r in got] == [1.5, round(9.5 / 3, 9), 3.5, 4.5]
    assert clean.fill_numeric(df, "drop")[0].count() == 2
    x, _ = clean.fill_numeric(df, "value", 0)
    assert x.filter("col1 = 0 or col2 = 0").count() == 2
    x, rep = clean.fill_numeric(df, "keep")
    assert rep["numeric_missing_after"] == {"col1": 1, "col2": 1}


def test_categorical_fill_and_empty_columns(spark):
    df = spark.createDataFrame([("value1", None, 1), (None, None, 2)], "c1 string, c2 string, n int")
    x, rep = clean.fill_categorical(df)
    assert rep["categorical_missing_filled"] == {"c1": 1, "c2": 2}
    y, dropped = clean.drop_empty_columns(df)
    assert dropped == ["c2"] and y.columns == ["c1", "n"]


def _pandas_iqr(pdf: pd.DataFrame, k: float = 2.5) -> pd.DataFrame:
    for col in pdf.select_dtypes(include=[np.number]).columns:
        if pdf[col].notna().sum() > 1:
            q1, q3 = pdf[col].quantile(0.25), pdf[col].quantile(0.75)
            iqr = q3 - q1
            pdf = pdf[(pdf[col] >= q1 - k * iqr) & (pdf[col] <= q3 + k * iqr)]
    return pdf


def test_sequential_iqr_matches_pandas(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.standard_t(2, 800), "b": rng.exponential(3, 800), "c": rng.integers(0, 9, 800)})
    pdf.loc[::37, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    x, _ = clean.filter_outliers(df)
    want = _pandas_iqr(pdf)
    assert x.count() == len(want)
    got = sorted(round(r.a, 9) for r in x.collect())
    assert got == sorted(round(v, 9) for v in want["a"])


def test_apply_cleaning_spec_ignores_unknown(spark):
    df = spark.createDataFrame([(" a ", 1.0), (" a ", 1.0), ("b", None)], "s string, v double")
    x, rep = clean.apply_cleaning(df, '{"cleaning_methods": [{"method": "drop_duplicates"}, '
                                      '{"method": "fill_missing_numeric_values", "params": {"method": "valor", "value": 9}},'
                                      ' {"method": "nope"}]}')
    assert sorted((r.s, r.v) for r in x.collect()) == [("a", 1.0), ("b", 9.0)]
    same, _ = clean.apply_cleaning(df, "{not json", mandatory=False)
    assert same.count() == 3


def test_report_counts_ride_on_the_steps(spark):
    """The fused counts are those of the steps run one by one, for every way to fill."""
    rows = [(i % 40, None if i % 7 == 0 else float(i % 40), None if i % 5 == 0 else " a ", None) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, v double, s string, e string")
    for how in ("mean", "drop", "keep"):
        out, rep = clean.clean_table(df, numeric_fill=how)
        x = clean.drop_duplicates(clean.cast_numeric_columns(clean.blank_to_null(clean.trim_cells(df)))[0])
        assert (rep["initial_rows"], rep["duplicates_removed"]) == (80, 80 - x.count())
        x, r = clean.fill_numeric(x, how)
        assert rep["numeric_missing_before"] == r["numeric_missing_before"]
        x, r = clean.fill_categorical(x)
        assert rep["categorical_missing_filled"] == r["categorical_missing_filled"]
        assert rep["final_rows"] == out.count() == x.count() - sum(rep["outliers_removed"].values())
        assert rep["final_columns"] == out.columns
    plain, none = clean.clean_table(df, remove_duplicates=False, with_report=False)
    assert none["duplicates_removed"] == 0 and plain.count() <= 80
    empty, rep = clean.clean_table(df.filter("i < 0"))
    assert (rep["initial_rows"], rep["duplicates_removed"], rep["final_rows"]) == (0, 0, 0)
