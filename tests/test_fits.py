"""Projections against an independent series, fits against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import projection
from tidemark.operators import fits, stats
from tidemark.plans import carriers as k
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def redfearn(lon, lat, zone):
    """UTM by Redfearn's series about the central meridian, with the meridian's arc integrated numerically."""
    a, f = projection.WGS84
    e2 = f * (2 - f)
    p = math.radians(lat)
    x, wts = np.polynomial.legendre.leggauss(80)
    arc = float(np.sum(wts * a * (1 - e2) / (1 - e2 * np.sin(p / 2 * (x + 1)) ** 2) ** 1.5) * p / 2)
    nu, rho = a / math.sqrt(1 - e2 * math.sin(p) ** 2), a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    q, t, c, w = nu / rho, math.tan(p), math.cos(p), math.radians(lon - (zone * 6 - 183))
    east = nu * w * c * (1 + w**2 * c**2 / 6 * (q - t**2) + w**4 * c**4 / 120 * (4 * q**3 * (1 - 6 * t**2) + q**2 * (1 + 8 * t**2) - q * 2 * t**2 + t**4) + w**6 * c**6 / 5040 * (61 - 479 * t**2 + 179 * t**4 - t**6))
    north = arc + nu * t * c**2 * w**2 / 2 * (
        1 + w**2 * c**2 / 12 * (4 * q**2 + q - t**2) + w**4 * c**4 / 360 * (8 * q**4 * (11 - 24 * t**2) - 28 * q**3 * (1 - 6 * t**2) + q**2 * (1 - 32 * t**2) - q * 2 * t**2 + t**4) + w**6 * c**6 / 20160 * (1385 - 3111 * t**2 + 543 * t**4 - t**6)
    )
    return 500_000 + 0.9996 * east, 0.9996 * north


def test_projection(spark):
    places = [(-117.25, 32.95), (-117.0, 0.0), (-117.0, 45.0), (-119.5, 60.0), (-114.2, 33.3), (-117.6, -30.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    got = df.select("lon", "lat", *projection.to_utm(F.col("lon"), F.col("lat"), 11)).collect()
    for r in got:
        assert r[2:] == pytest.approx(redfearn(r[0], r[1], 11), abs=1e-3)
    back = df.select("lon", "lat", *[c.alias(n) for n, c in zip("xy", projection.to_utm(F.col("lon"), F.col("lat"), 11, south=True))])
    for r in back.select("lon", "lat", *projection.from_utm(F.col("x"), F.col("y"), 11, south=True)).collect():
        assert r[2:] == pytest.approx(r[:2], abs=1e-10)
    assert projection.series()["radius"] / projection.SCALE == pytest.approx(6367449.145823, abs=1e-5)  # the WGS84 meridian's quarter over pi / 2


def newton(x):
    l = np.log(x)
    k = math.pi / math.sqrt(6) / l.std()
    for _ in range(100):
        w = x**k
        m = (w * l).sum() / w.sum()
        k -= (m - 1 / k - l.mean()) / ((w * l * l).sum() / w.sum() - m * m + 1 / k**2)
    return k, (x**k).mean() ** (1 / k)


def test_weibull(spark):
    rng = np.random.default_rng(5)
    groups = {"a": 2.5 * rng.weibull(1.7, 800), "b": 1e-3 * rng.weibull(0.6, 300), None: 40 * rng.weibull(6.0, 200)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("c", 3.0)] * 4 + [("a", -1.0), ("a", None), ("d", 0.0)]
    got = {r["g"]: r for r in fits.weibull(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g, x in groups.items():
        assert (got[g]["shape"], got[g]["scale"]) == pytest.approx(newton(x), rel=1e-6) and got[g]["n"] == len(x)
    assert got["c"]["shape"] is None and "d" not in got


def test_weibull_of_all_sites(spark):
    rows = k.waves(spark, SF).where("hs > 0").select("mop_id", "hs").toPandas()
    got = {r["mop_id"]: (r["shape"], r["scale"]) for r in QUERIES["wave_weibull"](spark, SF).collect()}
    for site, x in rows.groupby("mop_id")["hs"]:
        assert got[site] == pytest.approx(newton(x.to_numpy()), rel=1e-6, abs=2e-6)


def test_extremes():
    rng = np.random.default_rng(8)
    for shape, n in ((0.2, 300), (-0.15, 400), (0.0, 500), (0.1, 40)):
        y = -np.log(rng.uniform(size=n))
        x = 5 + 2 * ((1 - y**shape) / shape if shape else -np.log(y))
        c, place, scale = fits.fit_extremes(x)
        best = fits._minus_log_likelihood(np.array([c, place, math.log(scale)]), x)
        # no neighbour is likelier, and the gradient vanishes
        for d in (1e-3, 1e-4):
            for i in range(3):
                for sign in (1, -1):
                    q = np.array([c, place, math.log(scale)])
                    q[i] += sign * d
                    assert fits._minus_log_likelihood(q, x) >= best - 1e-9
        if n >= 300:
            assert abs(c - shape) < 0.12 and abs(place - 5) < 0.4 and abs(scale - 2) < 0.3


def test_return_levels(spark):
    rows = [("a", dt.date(1900 + i, 3, 1), float(v)) for i, v in enumerate(10 - 2 * np.log(-np.log(np.random.default_rng(2).uniform(size=90))))]
    rows += [("a", dt.date(1900, 2, 1), 0.0), ("b", dt.date(2000, 1, 1), 1.0), ("c", dt.date(2000, 1, 1), None)] + [("e", dt.date(2000 + i, 1, 1), 7.0) for i in range(5)]
    got = {(r["g"], r["period"]): r for r in fits.extremes(spark.createDataFrame(rows, "g string, d date, v double"), ["g"], "d", "v").collect()}
    assert got["a", 2]["n"] == 90 and got["b", 2]["level"] is None and got["e", 2]["shape"] is None and ("c", 2) not in got
    levels = [got["a", p]["level"] for p in (2, 5, 10, 20, 50, 100)]
    assert levels == sorted(levels)
    c, place, scale = (got["a", 2][x] for x in ("shape", "place", "scale"))
    for p in (2, 100):
        z = (got["a", p]["level"] - place) / scale
        assert math.exp(-((1 - c * z) ** (1 / c))) == pytest.approx(1 - 1 / p, abs=1e-9)
    assert QUERIES["climate_extreme_levels"](spark, SF).count() == 6 * 3


def test_hexagons(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.uniform(0, 10, (500, 2)), [[0, 0], [10, 10]]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in xy] + [(None, 1.0)], "x double, y double")
    got = stats.hexbin(df, "x", "y", 10).collect()
    assert sum(r["n"] for r in got) == 502
    sx, sy = 10 / 10, 10 / 5
    centres = np.array([(r["cx"], r["cy"]) for r in got])
    own = np.array([((xy[:, 0] - a) / sx) ** 2 + 3 * ((xy[:, 1] - b) / sy) ** 2 for a, b in centres]).min(axis=0)
    assert own.max() <= 1 / 3 + 1e-6  # no point is farther than a hexagon's corner
    assert stats.hexbin(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y").collect()[0]["n"] == 3
