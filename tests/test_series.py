import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import climate, waves
from tidemark.operators import series

DAY = dt.date(2023, 1, 1)
# The vectors of the tests up to storms are fixed values, with the results they must have.


def daily(spark, precip, **more):
    rows = [(0, DAY + dt.timedelta(days=i), *v) for i, v in enumerate(zip(precip, *more.values()))]
    names = ", ".join(f"{c} double" for c in ("precip_mm", *more))
    return spark.createDataFrame(rows, f"beach long, date date, {names}")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def hourly(spark, hs):
    start = dt.datetime(2023, 9, 15)
    return spark.createDataFrame([(582, start + dt.timedelta(hours=i), v) for i, v in enumerate(hs)], "mop_id int, ts timestamp_ntz, hs double")


def test_recurrence(spark):
    out = series.recurrence(daily(spark, [10.0, 0.0, 0.0, 5.0, 0.0]), ["beach"], "date", "precip_mm", 0.9, "api")
    assert column(out, "api") == pytest.approx([10, 9, 8.1, 12.29, 11.061])


def test_vapour_deficit(spark):
    df = spark.createDataFrame([(20.0, 20.0), (20.0, 15.0), (None, 1.0)], "t double, d double")
    a, b, c = [r[0] for r in df.select(climate.vapour_deficit(F.col("t"), F.col("d"))).collect()]
    assert a == 0 and 0 < b < 2 and c is None


def test_intensity(spark):
    out = daily(spark, [0.0, 0.5, 1.0, 5.0, 10.0, 20.0, 25.0, 100.0]).withColumn("k", climate.intensity_class(F.col("precip_mm")))
    assert column(out, "k") == [0, 0, 1, 1, 2, 2, 3, 3]


def test_wet_dry_and_freeze(spark):
    t = [2.0, -1.0, -5.0, 0.0, 2.0, 3.0, 4.0]
    x = series.climate_features(daily(spark, [5.0, 3.0, 0.0, 2.0, 0.0, 0.0, 4.0], temp_mean_c=t, temp_min_c=t, temp_max_c=t, dewpoint_c=t), ["beach"])
    assert column(x, "wet_dry_cycles_30d")[-1] == 2
    assert column(x, "freeze_flag")[:5] == [0, 1, 1, 0, 0]
    assert column(x, "freeze_thaw_30d")[-1] == 1
    assert column(x, "days_since_rain") == [0, 0, 1, 0, 1, 2, 0]
    assert column(x, "consecutive_dry_days") == [0, 0, 0, 1, 0, 1, 2]
    assert len(x.columns) >= 2 + 5 + 17


@pytest.mark.parametrize(
    "hs, n, rows",
    [([1.0] * 50 + [3.0] * 24 + [1.0] * 26, 1, 24), ([1.0] * 20 + [3.0] * 12 + [1.0] * 24 + [3.0] * 18 + [1.0] * 26, 2, 30), ([1.0] * 100, 0, 0), ([3.0] * 4 + [1.0] * 10 + [3.0] * 4, 1, 8)],
)
def test_storms(spark, hs, n, rows):
    out = series.storms(hourly(spark, hs), ["mop_id"]).collect()
    assert len(out) == n and sum(r["n_rows"] for r in out) == rows
    if n == 1 and rows == 24:
        assert out[0]["hours"] == 23


def test_circular_mean(spark):
    mean = lambda v: spark.createDataFrame([(float(x),) for x in v], "d double").agg(waves.circular_mean(F.col("d"))).first()[0]
    m = mean([350, 10])
    assert min(m, 360 - m) < 1e-6
    assert mean([45, 45, 45]) == pytest.approx(45)


def test_physics(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 10.0), (None, 5.0)], "hs double, tp double")
    rows = df.select(waves.power(F.col("hs"), F.col("tp")), waves.runup(F.col("hs"), F.col("tp"))).collect()
    assert rows[0][0] == pytest.approx(1025 * 9.81**2 / (64 * math.pi) * 4 * 10 / 1000)
    assert rows[0][1] > 0 and rows[1][1] == 0 and rows[2][1] == 0 and rows[2][0] is None


def test_fill_linear(spark):
    v = [None, 1.0, None, None, None, None, 6.0, None, None]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v double")
    both = [r["v"] for r in series.fill_linear(df, ["k"], "i", "v").orderBy("i").collect()]
    assert both == pytest.approx([1, 1, 2, 3, 4, 5, 6, 6, 6])
    first = [r["v"] for r in series.fill_linear(df, ["k"], "i", "v", limit=3, extend=False).orderBy("i").collect()]
    assert first == [None, 1, 2, 3, 4, None, 6, 6, 6]


def test_daily_window_keeps_nulls_of_a_whole_window(spark):
    whole = spark.createDataFrame([(0, DAY + dt.timedelta(days=i), None if i == 2 else float(i)) for i in range(5)], "beach long, date date, v double")
    scans = spark.createDataFrame([(1, 0, DAY + dt.timedelta(days=4))], "scan int, beach long, scan_date date")
    run = lambda d: [r["v"] for r in series.daily_window(scans, d, ["beach"], "scan_date", "date", ["v"], 5, ["scan"]).orderBy("day_no").collect()]
    assert run(whole) == [0, 1, None, 3, 4]
    assert run(whole.where("v is not null")) == [0, 1, 2, 3, 4]
    assert run(whole.where("false")) == [0] * 5


def test_resample_slots(spark):
    out = series.resample(hourly(spark, [1.0] * 24).withColumn("tp", F.lit(9.0)).withColumn("dp", F.lit(10.0)), ["mop_id"])
    assert out.count() == 4


def test_recurrence_of_repeats_nulls_and_long_series(spark):
    rows = [("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, None), (None, 5, 1.0), (None, 6, 1.0)]
    df = spark.createDataFrame(rows, "b string, o int, x double")
    got = sorted(((r["b"] or "-", r["o"], round(r["y"], 9)) for r in series.recurrence(df, ["b"], "o", "x", 0.5, "y").collect()))
    assert got == [("-", 5, 1.0), ("-", 6, 1.5), ("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 2.0)]
    xs = [None if i % 11 == 3 else (i * 37 % 101) / 7 for i in range(9000)]
    long = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "b string, o int, x double")
    for k in (0.9, 0.9999, -0.8, 0.05, 1e-150, 0.0, 1.0, 1.01):
        y, want = 0.0, []
        for x in xs:
            y = (x or 0.0) + k * y
            want.append(y)
        assert [r["y"] for r in series.recurrence(long, ["b"], "o", "x", k, "y").orderBy("o").collect()] == pytest.approx(want, rel=1e-9, abs=1e-9)
    plan = series.recurrence(long, ["b"], "o", "x", 0.9, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_lookback_ends_with_the_scan(spark):
    at = lambda h, m=0: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h, minutes=m)
    waves_ = [(1, at(0), 1.0), (1, at(5, 59), 3.0), (1, at(6), 10.0), (1, at(12), 5.0), (1, at(12, 1), 99.0), (2, at(6), 77.0), (None, at(6), 55.0), (1, at(-1), None)]
    series_ = spark.createDataFrame(waves_, "site long, ts timestamp, hs double")
    scans = spark.createDataFrame([("a", 1, at(12)), ("b", 1, at(12, 30)), ("c", 3, at(12)), ("d", None, at(12))], "scan string, site long, at timestamp")
    got = series.lookback_slots(scans, series_, ["site"], "at", "ts", ["hs"], 4, 6, ["scan"])
    by = {(r["scan"], r["slot"]): r["hs"] for r in got.collect()}
    assert len(by) == 16
    assert [by["a", i] for i in range(4)] == [None, 2.0, 10.0, 5.0]  # the row after the scan is left out
    assert [by["b", i] for i in range(4)] == [1.0, pytest.approx(6.5), pytest.approx(52.0), None]
    assert [by["c", i] for i in range(4)] == [None] * 4


def test_wave_tensor_fills_and_falls_back(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, at(0), 2.0, 8.0, 350.0), (1, at(1), 2.0, 8.0, 10.0), (1, at(18), 5.0, 8.0, 0.0), (2, at(0), 2.0, None, 10.0)]
    x = spark.createDataFrame(rows, "site long, ts timestamp, hs double, tp double, dp double")
    scans = spark.createDataFrame([("a", 1, at(18)), ("b", 2, at(18)), ("c", 3, at(18))], "scan string, site long, at timestamp")
    got = {(r["scan"], r["slot"]): r for r in series.wave_tensor(scans, x, ["site"], "at", 5, 6, ["scan"]).collect()}
    assert [round(got["a", i]["hs"], 6) for i in range(5)] == [2, 2, 3, 4, 5]
    assert min(got["a", 1]["dp"], 360 - got["a", 1]["dp"]) < 1e-6 and [got["a", i]["doy"] for i in (0, 1)] == [365, 1]
    assert all(got[s, i][c] == 0 for s in "bc" for i in range(5) for c in ("hs", "tp", "dp", "power"))


def test_lookback_shuffles_scans_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + dt.timedelta(minutes=37 * i), None if i % 7 == 0 else float("nan") if i == 50 else i * 1.5) for i in range(600)]
    x = spark.createDataFrame(rows, "scan long, site long, ts timestamp, hs double")
    got = series.lookback_slots(x.withColumnRenamed("ts", "at"), x, ["site"], "at", "ts", ["hs"], 20, 6, ["scan"])
    for r in got.collect():
        _, site, to, _ = rows[r["scan"]]
        lo = to - dt.timedelta(hours=6 * (19 - r["slot"]))
        v = [h for _, s, t, h in rows if s == site and lo <= t < lo + dt.timedelta(hours=6) and t <= to and h is not None]
        assert (r["hs"] is None and not v) or r["hs"] == pytest.approx(sum(v) / len(v), nan_ok=True)
    assert got.count() == 20 * len(rows)
    x = x.withColumns({"tp": F.lit(8.0), "dp": F.lit(10.0)})
    plan = series.wave_tensor(x.withColumnRenamed("ts", "at"), x, ["site"], "at", 20, 6, ["scan"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
