"""Summaries of waves and cliffs against known cases."""

import datetime as dt

import pytest

from tidemark.operators import history

# The series and detections below, and what must come of them.
STORMS = [
    ([1.0] * 100, 0, 0, 0, 100),
    ([1.0] * 50 + [3.0] * 24 + [1.0] * 26, 1, 24, 23, 26),
    ([1.0] * 20 + [3.0] * 12 + [1.0] * 24 + [2.5] * 18 + [1.0] * 26, 2, 30, 17, 26),
    ([3.0] * 50 + [1.0] * 50, 1, 50, 49, 50),
]
CLIFFS = [
    ([(-1.0, -1.0, 0.0, 0.0, False)] * 2, (2, 0, 0.0, 0.0, 0.0, 0.0)),
    ([(10.0, 50.0, 0.8, 0.85, True), (15.0, 55.0, 0.9, 0.75, True), (-1.0, -1.0, 0.0, 0.0, False)], (3, 2, 2 / 3, 40.0, 0.85, 0.8)),
    (
        [(10.0, 50.0, 0.8, 0.85, True), (11.0, 51.0, 0.7, 0.75, True), (-1.0, -1.0, 0.0, 0.0, False), (15.0, 55.0, 0.9, 0.8, True), (-1.0, -1.0, 0.0, 0.0, False), (16.0, 56.0, 0.85, 0.9, True)],
        (6, 4, 4 / 6, 40.0, 0.8125, 0.825),
    ),
]


@pytest.mark.parametrize("hs, count, hours, longest, since", STORMS)
def test_wave_metrics(spark, hs, count, hours, longest, since):
    start = dt.datetime(2023, 1, 1)
    rows = spark.createDataFrame([(1, start + dt.timedelta(hours=i), h, 10.0, 270.0) for i, h in enumerate(hs)], "mop_id int, ts timestamp, hs double, tp double, dp double")
    r = history.wave_metrics(rows, ["mop_id"]).first()
    assert (r["storm_count"], r["storm_hours"], r["max_storm_duration_hr"], r["time_since_storm_hr"]) == (count, hours, longest, since)
    assert r["hs_m"] == pytest.approx(sum(hs) / len(hs)) and r["max_hs_m"] == max(hs) and r["dp_deg"] == pytest.approx(270) and r["mean_power_kw"] == r["power_kw"]
    assert r["shore_normal_hs_m"] == pytest.approx(r["hs_m"]) and r["runup_2pct_m"] > 0 and len(r) == 20  # the site and 19 metrics


@pytest.mark.parametrize("rows, want", CLIFFS)
def test_cliff_metrics(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, toe double, top double, toe_confidence double, top_confidence double, has_cliff boolean")
    r = history.cliff_metrics(df, ["g"]).first()
    assert (r["n_valid"], r["n_detected"], r["detection_rate"], r["mean_cliff_width_m"], r["mean_toe_confidence"], r["mean_top_confidence"]) == pytest.approx(want)


def test_radiation_stress_only_where_it_is_known(spark):
    rows = [(1, 2.0, 8.0, 270.0, 0.5, None), (1, 2.0, 8.0, 270.0, -0.2, None), (1, None, None, 270.0, None, None)]
    df = spark.createDataFrame(rows, "g int, hs double, tp double, dp double, sxy double, sxx double")
    r = history.epoch_features(df, ["g"]).first()
    assert (r["sxy_net"], r["sxx_net"]) == (pytest.approx(0.3), 0.0) and len(r) == 21
    assert history.epoch_features(df.drop("sxy", "sxx"), ["g"]).first()["sxy_net"] is None
