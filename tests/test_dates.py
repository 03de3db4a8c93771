"""Date repair: closed forms against a sequential loop, regularity rules on crafted series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kiln.operators import dates

EPOCH = dt.datetime(1970, 1, 1)


def _loop_impute(us, delta):
    """The sequential fill of the reference, in integer microseconds (truncating halves)."""
    vals = list(us)
    for i, v in enumerate(vals):
        if v is not None:
            continue
        prev = next((vals[j] for j in range(i - 1, -1, -1) if vals[j] is not None), None)
        nxt = next((vals[j] for j in range(i + 1, len(vals)) if vals[j] is not None), None)
        if prev is not None and nxt is not None:
            d = nxt - prev
            vals[i] = prev + (abs(d) // 2) * (1 if d >= 0 else -1)
        elif prev is not None:
            vals[i] = prev + delta
        elif nxt is not None:
            vals[i] = nxt - delta
    return vals


def _to_ts(v):
    return None if v is None else EPOCH + dt.timedelta(microseconds=v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_impute_closed_forms_match_loop(spark, seed):
    rnd = random.Random(seed)
    n = 300
    base = [1_700_000_000_000_000 + i * 3_600_000_000 + rnd.randint(-9_999_999, 9_999_999) for i in range(n)]
    us = [None if rnd.random() < 0.35 else b for b in base]
    us[0] = us[1] = None
    us[-1] = None
    rows = [(i, _to_ts(v)) for i, v in enumerate(us)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz")
    valid = sorted(v for v in us if v is not None)
    delta = (valid[-1] - valid[0]) // (len(valid) - 1)
    want = _loop_impute(us, delta)
    got = {r.i: r.ts for r in dates.impute_dates(df, "ts", order_cols=["i"], block=17).collect()}
    assert [got[i] for i in range(n)] == [_to_ts(v) for v in want]


def test_impute_leave_and_too_few(spark):
    df = spark.createDataFrame([(0, None), (1, dt.datetime(2024, 1, 1)), (2, None)], "i long, ts timestamp_ntz")
    assert dates.impute_dates(df, "ts", ["i"], strategy="leave_as_is").filter("ts is null").count() == 2
    assert dates.impute_dates(df, "ts", ["i"]).filter("ts is null").count() == 2


def test_detect_step_snaps(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(days=i) + dt.timedelta(minutes=(i % 3))) for i in range(40)]
    rows += [("b", t0 + dt.timedelta(seconds=37 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    got = {r.k: r.step_seconds for r in dates.detect_step(df, "ts", key="k").collect()}
    assert got["a"] == 86400.0
    assert got["b"] == 37.0


def test_spread_duplicates_running_counter(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(0, t), (1, t), (2, t), (3, t + dt.timedelta(hours=1)), (4, t + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz")
    got = {r.i: r.ts for r in dates.spread_duplicates(df, "ts", ["i"], block=2).collect()}
    ms = dt.timedelta(milliseconds=1)
    assert got == {0: t, 1: t + ms, 2: t + 2 * ms, 3: t + dt.timedelta(hours=1), 4: t + dt.timedelta(hours=1) + 3 * ms}


def _series(spark, stamps):
    return spark.createDataFrame([("s", s) for s in stamps], "k string, ts timestamp_ntz")


def test_regularity_rules(spark):
    t0 = dt.datetime(2024, 1, 1)
    cases = {
        "hourly": ([t0 + dt.timedelta(hours=i, minutes=(i % 2) * 4) for i in range(50)], True),
        "sub_hourly": ([t0 + dt.timedelta(minutes=15 * i) for i in range(50)], False),
        "daily": ([t0 + dt.timedelta(days=i) for i in range(50)], True),
        "daily_gap": ([t0 + dt.timedelta(days=i) for i in range(50) if i != 20], False),
        "monthly": ([dt.datetime(2020 + (m // 12), m % 12 + 1, 15) for m in range(30)], True),
        "weekly": ([t0 + dt.timedelta(weeks=i) for i in range(30)], False),
        "yearly": ([dt.datetime(2000 + y, 3, 1) for y in range(12)], True),
    }
    for name, (stamps, want) in cases.items():
        got = dates.is_regular(_series(spark, stamps), "ts", key="k").first()["is_regular"]
        assert got is want, name
    one = dates.is_regular(_series(spark, [t0]), "ts", key="k").first()["is_regular"]
    assert one is None


def test_parse_dates_first_format(spark):
    df = spark.createDataFrame([(0, "28/05/1997"), (1, "bad"), (2, "03/04/1999"), (3, "1999-04-03")],
                               "k long, s string")
    got = {r.k: r.p for r in dates.parse_dates(df, "s", order_cols=["k"], out="p").collect()}
    assert got[0] == dt.datetime(1997, 5, 28) and got[2] == dt.datetime(1999, 4, 3)
    assert got[1] is None and got[3] is None  # not in the chosen day-first format
    # no format fits the first value: every row on its own, month first (as pandas does)
    bad = spark.createDataFrame([(0, "garbage"), (1, "05/03/2024"), (2, "31/12/2024")], "k long, s string")
    got = {r.k: r.p for r in dates.parse_dates(bad, "s", order_cols=["k"], out="p").collect()}
    assert got == {0: None, 1: dt.datetime(2024, 5, 3), 2: dt.datetime(2024, 12, 31)}
    anym = {r.k: r.p for r in dates.parse_dates(df, "s", mode="any", out="p").collect()}
    assert anym[3] == dt.datetime(1999, 4, 3)


def test_detect_format(spark):
    df = spark.createDataFrame([(0, "2024-01-02"), (1, "2024-01-03 10:00:00+02:00"), (2, "2024-01-04")],
                               "k long, s string")
    r = dates.detect_format(df, "s", order_cols=["k"]).first()
    assert r.detected_format == "%Y-%m-%d"
    assert abs(r.success_rate - 2 / 3) < 1e-12
    assert r.timezone_info == "Timezone detected"
    # three of five values are tested, all five count for the rate
    five = spark.createDataFrame([(i, f"2024-01-0{i + 1}") for i in range(5)], "k long, s string")
    assert abs(dates.detect_format(five, "s", order_cols=["k"]).first().success_rate - 0.6) < 1e-12


def test_month_end_series_keeps_its_values(spark):
    ends = [dt.datetime(2024, 4, 30), dt.datetime(2024, 5, 31), dt.datetime(2024, 6, 30), dt.datetime(2024, 7, 31)]
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(ends)], "k string, ts timestamp_ntz, v double")
    out = dates.load_series(df, "ts", "v", key="k").orderBy("ts").collect()
    assert [(r.ts, r.v) for r in out] == [(t, float(i)) for i, t in enumerate(ends)]
    gap = dates.reindex(df.filter("v != 1"), "ts", key="k", steps=dates.infer_step(df, "ts", key="k")).orderBy("ts").collect()
    assert [r.ts for r in gap] == ends and [r.v for r in gap] == [0.0, None, 2.0, 3.0]


def test_hour_only_offsets(spark):
    df = spark.createDataFrame([(0, "2024-01-01 10:00:00+02"), (1, "2024-01-01 10:00:00"), (2, "2024-01-01")], "k long, s string")
    u = {r.k: r.h for r in dates.to_utc(df, "s", out="t").select("k", F.hour("t").alias("h")).collect()}
    assert u == {0: 8, 1: 10, 2: 0}
    k = {r.k: (r.t.hour, r.t_offset_minutes) for r in dates.keep_tz(df, "s", out="t").collect()}
    assert k == {0: (10, 120), 1: (10, None), 2: (0, None)}


def test_reindex_inserts_missing_steps(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0, 1.0), ("a", t0 + dt.timedelta(days=3), 2.0)], "k string, ts timestamp_ntz, v double")
    out = dates.reindex(df, "ts", key="k", step_us=86_400_000_000).orderBy("ts").collect()
    assert [r.v for r in out] == [1.0, None, None, 2.0]
    with pytest.raises(ValueError):
        dates.load_series(df, "ts", "v", key="k")  # two points: no frequency
    m = spark.createDataFrame([("a", dt.datetime(2024, m, 1), float(m)) for m in (1, 2, 3, 5)], "k string, ts timestamp_ntz, v double")
    steps = dates.infer_step(m.filter(F.month("ts") < 4), "ts", key="k").first()
    assert steps.step_months == 1


def test_utc_keep_zone_and_preview(spark):
    df = spark.createDataFrame([(0, "2024-01-02 10:00:00+02:00"), (1, "2024-01-02 10:00:00-0530"),
                                (2, "2024-01-02 10:00:00"), (3, "nope")], "k long, s string")
    u = {r.k: r.us for r in dates.to_utc(df, "s", out="t").select("k", F.unix_micros("t").alias("us")).collect()}
    base = int(dt.datetime(2024, 1, 2, 10, 0).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert u[0] == base - 2 * 3600 * 1_000_000 and u[1] == base + 330 * 60 * 1_000_000 and u[2] == base
    assert u[3] is None
    k = {r.k: (r.t, r.t_offset_minutes) for r in dates.keep_tz(df, "s", out="t").collect()}
    assert k[0] == (dt.datetime(2024, 1, 2, 10, 0), 120) and k[1][1] == -330 and k[2][1] is None
    prev = dates.preview_dates(df, "s", order_cols=["k"], n=5).collect()
    assert len(prev) == 4 and prev[0].transformed == "2024-01-02T08:00:00+00:00"
    assert sum(1 for r in prev if r.warning) == 1
    missing = dates.preview_dates(df, "nope_col").first()
    assert "not found" in missing.warning


def test_cleaning_list_with_dates(spark):
    from kiln.operators import clean

    df = spark.createDataFrame([(0, "2024-01-01 00:00:00"), (1, None), (2, "2024-01-03 00:00:00")], "k long, d string")
    spec = {"cleaning_methods": [{"method": "standardize_date_to_utc",
                                  "params": {"date_column": "d", "order_cols": ["k"]}}]}
    x, rep = clean.apply_cleaning(df, spec, with_regularity=False)
    got = {r.k: r.d for r in x.collect()}
    assert got[1] is not None
    spec2 = {"cleaning_methods": [{"method": "standardize_date_to_utc", "params": {"date_column": "d"}}]}
    _, rep2 = clean.apply_cleaning(df, spec2)
    assert rep2["date_standardization"]["invalid_dates_found"] == 1
    assert rep2["date_standardization"]["strategy"].startswith("skipped")
    # the whole step: a bad date, a repeated one, offsets
    odd = spark.createDataFrame([(0, "2024-01-01 00:00:00+02:00"), (1, "bad"), (2, "2024-01-03 00:00:00+02:00"), (3, "2024-01-03 00:00:00+02:00")],
                                "k long, d string")
    keep = {"cleaning_methods": [{"method": "standardize_date_retain_timezone", "params": {"date_column": "d", "order_cols": ["k"]}}]}
    y, rep3 = clean.apply_cleaning(odd, keep, mandatory=False)
    found = rep3["date_standardization"]
    assert (found["parse_failures"], found["duplicate_timestamps"], found["timezone"], len(found["samples"])) == (1, 1, "UTC+02:00", 4)
    stamps = {r.k: r.d for r in y.collect()}
    assert stamps[1] == dt.datetime(2024, 1, 2) and stamps[3] - stamps[2] == dt.timedelta(milliseconds=1)


def test_preview_keep_mode(spark):
    df = spark.createDataFrame([(0, "2024-01-02 10:00:00+02:00"), (1, "2024-01-02 11:00:00"), (2, "x")],
                               "k long, s string")
    rows = {r.original: r for r in dates.preview_dates(df, "s", mode="keep", order_cols=["k"]).collect()}
    assert rows["2024-01-02 10:00:00+02:00"].transformed == "2024-01-02T10:00:00+02:00"
    assert rows["2024-01-02 11:00:00"].transformed == "2024-01-02T11:00:00"
    assert rows["x"].transformed is None and rows["x"].warning
