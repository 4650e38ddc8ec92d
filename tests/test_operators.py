import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry, labels
from tidemark.operators import cube, joins, profile, samples, stats
from tidemark.plans import carriers
from tidemark.plans.registry import QUERIES


def test_beach_boundaries(spark):
    p = spark.createDataFrame([(i, m) for i, m in enumerate([520, 567, 568, 600, 650, 700, 708, 750, 100, 1000])], "c_custkey long, mop int")
    b = carriers.beaches(spark)
    first = {r["mop"]: r["beach"] for r in joins.first_match(p, b, ["c_custkey"], "mop", "mop_lo", "mop_hi", "beach_order", ["beach"], 50).collect()}
    assert first == {520: "blacks", 567: "blacks", 568: "torrey", 600: "delmar", 650: "solana", 700: "sanelijo", 708: "sanelijo", 750: "encinitas", 100: None, 1000: None}
    near = {r["mop"]: r["beach"] for r in joins.nearest_range(p, b, ["c_custkey"], "mop", "mop_lo", "mop_hi", "beach_order", ["beach"]).collect()}
    assert near[100] == "blacks" and near[1000] == "encinitas" and near[567] == "blacks"


def test_band_join_against_all_pairs(spark):
    r = np.random.default_rng(1)
    pts, rng = r.uniform(0, 100, 200), [(i, a, a + w) for i, (a, w) in enumerate(zip(r.uniform(0, 90, 40), r.uniform(0, 15, 40)))]
    p = spark.createDataFrame([(i, float(v)) for i, v in enumerate(pts)], "k int, v double")
    g = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in rng], "g int, lo double, hi double")
    got = sorted((x["k"], x["g"]) for x in joins.band_join(p, g, "v", "lo", "hi", 4.0).collect())
    assert got == sorted((i, k) for i, v in enumerate(pts) for k, a, b in rng if a <= v <= b)


def test_overlapping_pairs_against_all_pairs(spark):
    """Ties, single places, equal keys, long intervals, nulls; the width of a cell changes nothing."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 150)), int(rng.integers(0, 3)), lo, lo + int(rng.choice([0, 1, 7, 8, 9, 40]))) for lo in map(int, rng.integers(-30, 60, 160))]
    odd = [(None, 0, 0, 9), (900, None, 0, 9), (901, 0, None, 9), (902, 0, 0, None)]
    want = sorted((p[0], q[0], p[1]) for p in rows for q in rows if p[1] == q[1] and p[0] < q[0] and p[2] <= q[3] and q[2] <= p[3])
    t = spark.createDataFrame(rows + odd, "i int, g int, lo int, hi int")
    for width in (1, 8, 90):
        assert sorted(map(tuple, joins.overlapping_pairs(t, "i", "lo", "hi", width, ["g"]).collect())) == want, width
    named = [t.select(F.col("i").alias(n), F.col("g").alias(f"g{n}"), F.col("lo").alias(f"lo{n}"), F.col("hi").alias(f"hi{n}")).dropna() for n in "ab"]
    assert sorted(map(tuple, joins.interval_overlap(*named, "loa", "hia", "lob", "hib", 8, [("ga", "gb")]).where("a < b").select("a", "b", "ga").collect())) == want


def test_overlapping_slumps_of_a_dense_transect_take_little_disk(spark, tmp_path):
    """All pairs are listed, and their files take under a byte a pair."""
    at = F.timestamp_seconds(F.lit(800_000_000) + F.floor(F.rand(3) * 100) * 86400)
    spark.range(1, 6001).select(F.col("id").alias("o_orderkey"), F.lit(50).cast("long").alias("o_custkey"), at.alias("o_orderdate"), F.lit(9.5).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 6001).select(F.col("id").alias("l_orderkey"), at.alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    QUERIES["event_overlap"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    n = QUERIES["event_overlap_counts"](spark, str(tmp_path)).agg({"n": "sum"}).first()[0] // 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == n > 10_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n


def test_asof_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 3, 30), ("a", 7, 70)], "k string, u int, v int")
    run = lambda **o: {(r["k"], r["t"]): r["v"] for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"], **o).collect()}
    assert run() == {("a", 5): 50, ("a", 1): None, ("b", 5): None}
    assert run(strict=True) == {("a", 5): 30, ("a", 1): None, ("b", 5): None}
    assert run(direction="forward") == {("a", 5): 50, ("a", 1): 30, ("b", 5): None}
    assert run(direction="forward", strict=True) == {("a", 5): 70, ("a", 1): 30, ("b", 5): None}
    with pytest.raises(ValueError):
        joins.asof_join(left, right, [], "t", "u", ["v"])


def test_corridor_against_loops(spark):
    r = np.random.default_rng(42)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(0, 50, 400), r.uniform(0, 10, 400)))]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    lines = spark.createDataFrame([(k, 0.0, float(y), 50.0, float(y)) for k, y in ((1, 3), (2, 5), (3, 7))], "tr_id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((q["tr_id"], q["id"]) for q in joins.corridor_join(p, lines, 1.0, 2.0).collect())
    assert got == sorted((k, i) for i, x, y in pts for k, l in ((1, 3), (2, 5), (3, 7)) if abs(y - l) <= 1)
    sampled = joins.corridor_join(p, lines, 1.0, 2.0, mode="sampled").count()
    assert 0.9 * len(got) <= sampled <= len(got)


def test_geometry(spark):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 15.0, 0.0, 20.0, 10.0)], "ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")
    a, b = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")
    assert d.select(geometry.boxes_overlap(a, b), geometry.boxes_overlap(a, b, 5), geometry.length("ax", "ay", "bx", "by")).first()[:2] == (False, True)
    assert d.select(geometry.azimuth(F.lit(-1.0), F.lit(0.0))).first()[0] == 270
    assert d.select(geometry.nice_length(F.lit(1200.0)), geometry.utm_zone(F.lit(-117.2))).first()[:] == (200.0, 11)


def test_names(spark):
    df = spark.createDataFrame([("MOP 595",), ("MOP 600_01",), ("MOP600",), ("595",), ("none",)], "n string")
    assert [r[0] for r in df.select(labels.mop_after_prefix(F.col("n"))).collect()] == [595, 600, 600, 595, None]
    t = spark.createDataFrame([(600.3,), (600.96,), (601.0,)], "m double").select(labels.transect_name(F.col("m"))).collect()
    assert [r[0] for r in t] == ["MOP 600_003", "MOP 601", "MOP 601"]
    n = spark.createDataFrame([("20180101_scan.las",), ("scan_2019-01-02.las",), ("20181399_x_20200105",), ("none",)], "n string").select(labels.name_date(F.col("n"))).collect()
    assert [r[0] for r in n] == [dt.date(2018, 1, 1), dt.date(2019, 1, 2), None, None]
    assert spark.range(1).select(labels.ordinal(F.lit("2023-03-15").cast("date"))).first()[0] == 738594
    paths = {"/Volumes/group/": "/project/group/", "/Volumes/": "/mnt/"}
    assert spark.range(1).select(labels.mapped_path(F.lit("/Volumes/group/a.las"), paths)).first()[0] == "/project/group/a.las"
    assert spark.range(1).select(labels.colour(F.lit(1.5), F.lit(None).cast("double"), F.lit(0.5))).first()[0] == "rgb(255,128,127)"


def test_roughness_is_what_a_fit_leaves(spark):
    r = np.random.default_rng(3)
    d, z = np.arange(12) * 0.7, r.normal(size=12)
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(d, z))]
    got = [x["roughness"] for x in profile.roughness(spark.createDataFrame(rows, "k int, i int, distance double, elevation double"), ["k"]).orderBy("i").collect()]
    for i, g in enumerate(got):
        w = slice(max(0, i - 2), i + 3)
        fit = np.polyfit(d[w], z[w], 1)
        assert g == pytest.approx(np.std(z[w] - np.polyval(fit, d[w])), abs=1e-9)


def test_gradient_matches_numpy(spark):
    r = np.random.default_rng(4)
    d, z = np.cumsum(r.uniform(0.2, 2, 15)), r.normal(size=15)
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(d, z))], "k int, i int, distance double, elevation double")
    got = [x["g"] for x in profile.gradient(df, ["k"], "elevation", "distance", "g").orderBy("i").collect()]
    assert got == pytest.approx(np.gradient(z, d).tolist())


def test_regrid_matches_interp(spark):
    r = np.random.default_rng(5)
    d, z = np.sort(r.uniform(0, 50, 30)), r.normal(size=30)
    df = spark.createDataFrame([(0, float(a), float(b), float(i % 3)) for i, (a, b) in enumerate(zip(d, z))], "k int, distance double, elevation double, kind double")
    got = profile.regrid(df, ["k"], 17, ["elevation"], ["kind"]).orderBy("i").collect()
    grid = np.linspace(d[0], d[-1], 17)
    assert [g["elevation"] for g in got] == pytest.approx(np.interp(grid, d, z).tolist())
    assert all(g["kind"] in (0, 1, 2) for g in got)


def test_toe_and_top(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9, 0.1), (1, 5.0, 0.1, 0.8), (2, 1.0, 0.1, 0.9), (2, 5.0, 0.9, 0.1)], "k int, d double, p double, q double")
    got = {r["k"]: r["has_cliff"] for r in profile.toe_and_top(df, ["k"], "d", "p", "q").collect()}
    assert got == {1: True, 2: False}


def test_coverage_and_placement(spark):
    t = spark.createDataFrame([("MOP 100", 0), ("MOP 101", 1)], "transect string, transect_idx int")
    surveys = spark.createDataFrame([("b.las", dt.date(2019, 1, 1)), ("a.las", dt.date(2018, 1, 1)), ("bad", None)], "f string, d date")
    e = cube.epoch_dimension(surveys, "f", "d")
    assert [r["epoch_name"] for r in e.orderBy("epoch_idx").collect()] == ["bad", "a.las", "b.las"]
    rows = spark.createDataFrame([("MOP 100", "a.las", 1, 1.0), ("MOP 100", "a.las", 2, 2.0), ("MOP 9", "a.las", 3, 3.0)], "transect string, epoch_name string, n int, v double")
    cells = cube.place(rows, t, e, "transect", "epoch_name", ["n"])
    assert [(r["transect_idx"], r["epoch_idx"], r["v"]) for r in cells.collect()] == [(0, 1, 2.0)]
    assert cube.unmatched(rows, t, "transect").count() == 1
    all_ = [r for r in cube.coverage(cells, 2, 3).collect() if r["level"] == "all"][0]
    assert (all_["present"], all_["missing"], all_["is_full"]) == (1, 5, False)


def test_samples(spark):
    c = spark.createDataFrame([(0, i, float(i)) for i in range(6)], "t int, epoch_idx int, v double")
    got = samples.context(c, ["t"], "epoch_idx", "v", most=3, least=2).orderBy("epoch_idx").collect()
    assert [r["context"] for r in got][:2] == [[None, 0.0, 1.0], [0.0, 1.0, 2.0]]
    s = samples.hashed_split(spark.range(1000), "id")
    assert {r["split"] for r in s.collect()} == {"train", "validation", "test"}
    assert samples.subsample(spark.range(100), "id", 7).count() == 7
    edited = cube.upsert(spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), spark.createDataFrame([(2, 9), (3, 9)], "k int, v int"), ["k"])
    assert sorted(map(tuple, edited.collect())) == [(1, 0), (2, 9), (3, 9)]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k int, i int, distance double, elevation double")
    assert profile.regrid(e, ["k"], 5, ["elevation"]).count() == 0
    assert profile.cliff_features(e, ["k"]).count() == 0
    assert stats.histogram(e, "elevation", 5).count() == 0
    assert stats.monthly_counts(spark.createDataFrame([], "d date"), "d", F.lit(True)).count() == 0


def test_weighted_sample(spark):
    from tidemark.operators import selection

    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0)], "k long, w double")
    got = [r["k"] for r in selection.weighted_sample(rows, "k", "w", 2000).collect()]
    assert len(got) == 2000 and 1 not in got and 0.85 < got.count(3) / 2000 < 0.95
    ids = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    files = spark.createDataFrame([(1, 5), (2, 0)], "k int, n int")
    assert {r["k"]: r["status"] for r in selection.availability(ids, files, "k", "n").collect()} == {1: "valid", 2: "invalid", 3: "missing"}
