import datetime as dt

import pytest
from pyspark.sql import functions as F

from kiln.operators import encode, split, windows


def test_one_hot_fixture(spark):
    df = spark.createDataFrame([("A", 1.0, 0), ("B", 2.0, 1), ("C", 3.0, 0), ("A", 4.0, 1), ("B", 5.0, 0)],
                               "cat_feature string, num_feature double, target int")
    x = encode.one_hot(df, ["cat_feature", "num_feature"])
    assert x.columns == ["num_feature", "target", "cat_feature_B", "cat_feature_C"]
    assert [tuple(r) for r in x.select("cat_feature_B", "cat_feature_C").collect()] == [(0, 0), (1, 0), (0, 1), (0, 0), (1, 0)]


def test_target_encodings(spark):
    df = spark.createDataFrame([(10,), (2,), (None,), (2,)], "t int")
    oh = encode.one_hot_target(df, ["t"])
    assert oh.columns == ["t_nan", "t_2", "t_10"] or set(oh.columns) == {"t_nan", "t_2", "t_10"}
    le = encode.label_encode(df, ["t"])
    assert [r.t for r in le.collect()] == [1, 0, None, 0]  # numeric order, not text order
    with pytest.raises(ValueError):
        encode.check_target_encodings(["a"], ["b"])
    assert encode.usable(["x", "cat_vacio"]) == ["x"]


def test_lag_policies(spark):
    rows = [(i, float(i) if i % 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "i long, v double")
    lagged = encode.add_lags(df, ["v"], 2, order_cols=["i"], block=4)
    got = {r.i: (r.v_lag_1, r.v_lag_2) for r in lagged.collect()}
    assert got[5] == (4.0, None) and got[2] == (1.0, None)
    assert encode.handle_lag_nulls(lagged, "drop").count() == len([1 for i in range(2, 10) if all(
        (j % 3) for j in (i, i - 1, i - 2))])
    ff = {r.i: r.v for r in encode.handle_lag_nulls(df, "forward_fill", order_cols=["i"], block=3).collect()}
    assert ff[0] is None and ff[3] == 2.0 and ff[6] == 5.0
    with pytest.raises(ValueError):
        encode.handle_lag_nulls(df, "bogus")


@pytest.mark.parametrize("ratios,ok", [((0.7, 0.15, 0.149), True), ((0.7, 0.15, 0.151), True),
                                       ((0.7, 0.15, 0.152), False), ((1.0, 0.0, 0.0), True),
                                       ((0.8, -0.1, 0.3), False)])
def test_ratio_edges(ratios, ok):
    if ok:
        split.check_ratios(ratios)
    else:
        with pytest.raises(ValueError):
            split.check_ratios(ratios)


def test_stratified_cover_and_shares(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string")
    s1 = split.stratified_split(df, "y", (0.7, 0.15, 0.15), id_cols=["id"])
    s2 = split.stratified_split(df, "y", (0.7, 0.15, 0.15), id_cols=["id"])
    assert s1.count() == 1000 and s1.select("id").distinct().count() == 1000
    assert sorted(map(tuple, s1.collect())) == sorted(map(tuple, s2.collect()))  # reproducible
    c = {(r.y, r.split): r["count"] for r in s1.groupBy("y", "split").count().collect()}
    for cls, n in (("a", 750), ("b", 250)):
        assert abs(c[(cls, "train")] - 0.7 * n) <= 1
        assert abs(c[(cls, "test")] - 0.15 * n) <= 1


def test_temporal_split_counts(spark):
    df = spark.createDataFrame([(i,) for i in range(393)], "start long")
    s = {r.split: r["count"] for r in split.temporal_split(df, order_cols=["start"]).groupBy("split").count().collect()}
    assert s == {"train": 275, "val": 58, "test": 60}


def _daily(spark, n, chans=1):
    t0 = dt.datetime(2020, 1, 1)
    cols = ", ".join(f"feature_{j} double" for j in range(1, chans + 1))
    rows = [(t0 + dt.timedelta(days=i), *[float(i * 10 + j) for j in range(1, chans + 1)]) for i in range(n)]
    return spark.createDataFrame(rows, f"date timestamp_ntz, {cols}")


def test_sequence_windows(spark):
    d = _daily(spark, 100).withColumnRenamed("feature_1", "value")
    assert windows.sequences(d, [], "value", L=10, h=1, order_cols=["date"]).count() == 90
    d = _daily(spark, 200).withColumnRenamed("feature_1", "target")
    w = windows.sequences(d, [], "target", L=10, h=5, order_cols=["date"], block=33)
    assert w.count() == 186
    first = w.filter("start = 0").first()
    assert first.y == 14 * 10 + 1 and [v[0] for v in first.x] == [i * 10 + 1.0 for i in range(10)]
    with pytest.raises(ValueError):
        windows.sequences(_daily(spark, 50).withColumnRenamed("feature_1", "v"), [], "v", L=100, h=1,
                          order_cols=["date"])


def test_context_windows_and_split(spark):
    d = _daily(spark, 1000, chans=3)
    w = windows.context_windows(d, ["feature_1", "feature_2", "feature_3"], L=512, H=96, order_cols=["date"])
    assert w.count() == 393
    r = w.filter("start = 0").first()
    assert len(r.past) == 512 and len(r.future) == 96 and len(r.past[0]) == 3
    s = split.temporal_split(w.select("start"), order_cols=["start"], strict=True)
    assert {x.split: x["count"] for x in s.groupBy("split").count().collect()} == {"train": 275, "val": 58, "test": 60}


def test_rolling_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "t long")
    f = split.rolling_folds(df, W=21, h=2, folds=5, order_cols=["t"])
    got = {(r.fold, r.role): r["count"] for r in f.groupBy("fold", "role").count().collect()}
    assert got[(0, "train")] == 21 and got[(0, "test")] == 2
    assert got[(4, "test")] == 1  # last fold truncated
    assert (5, "train") not in got
