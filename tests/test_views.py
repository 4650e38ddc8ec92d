"""The label store, views, losses and overlap counts."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import cube, views
from tidemark.sources import files, labelstore


def test_an_edit_rewrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    transects = spark.range(40).selectExpr("cast(id as int) as transect_idx")
    epochs = spark.createDataFrame([(i, dt.date(2020, 1 + i, 1)) for i in range(5)], "epoch_idx int, epoch_date date")
    empty = labelstore.empty_labels(transects, epochs)
    assert empty.count() == 160 and labelstore.empty_labels(transects, epochs.limit(1)).count() == 0 == labelstore.empty_labels(transects, epochs.limit(0)).count()
    labelstore.create(empty, path, buckets=16)
    times = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "labels").glob("bucket=*/*.parquet")}
    before = times()
    edits = [(3, 0, 4, 0), (3, 1, 2, 0)]
    edit = lambda rows: spark.createDataFrame(rows, "transect_idx int, pair int, label int, version long")
    assert labelstore.save(edit(edits), path, "me") == 2
    after = times()
    kept, gone, new = before.keys() & after.keys(), before.keys() - after.keys(), after.keys() - before.keys()
    assert {f.parent for f in gone} == {f.parent for f in new} and len({f.parent for f in new}) == 1 and all(before[f] == after[f] for f in kept) and len(kept) >= 10
    rows = {(r["transect_idx"], r["pair"]): (r["label"], r["version"]) for r in labelstore.load(spark, path).collect()}
    assert len(rows) == 160 and rows[3, 0] == (4, 1) and rows[3, 2] == (-1, 0) and sum(v == 1 for _, v in rows.values()) == 2
    for bad in ([(3, 0, 1, 0)], [(99, 0, 1, 0)], [(3, 0, 1, 1), (3, 0, 2, 1)]):
        with pytest.raises(labelstore.Conflict):
            labelstore.save(edit(bad), path)
    assert labelstore.save(edit([]), path) == 0 and labelstore.save(edit([(3, 0, 1, 1)]), path) == 1
    (s,) = labelstore.summary(labelstore.load(spark, path)).collect()
    assert (s["n_labeled"], s["n_unlabeled"], s["label_counts"]) == (2, 158, [0, 1, 1, 0, 0])
    assert labelstore.compatibility(labelstore.load(spark, path), transects, epochs) == []
    assert len(labelstore.compatibility(labelstore.load(spark, path), transects.limit(3), epochs.limit(3))) == 2


def test_slices_and_features(spark):
    cells = spark.createDataFrame([(t, e, 1.0) for t in range(3) for e in (0, 1, 2)], "transect_idx int, epoch_idx int, z double")
    epochs = spark.createDataFrame([(e, dt.date(2020, 1 + e, 1)) for e in range(3)], "epoch_idx int, epoch_date date")
    assert {r["epoch_idx"] for r in cube.epoch_slice(cells, epochs, -1).collect()} == {2}
    with pytest.raises(IndexError):
        cube.epoch_slice(cells, epochs, 3)
    assert cube.feature_over_time(cells, ["transect_idx"], "epoch_idx", "z").count() == 9
    with pytest.raises(KeyError, match="there are z"):
        cube.feature_over_time(cells, ["transect_idx"], "epoch_idx", "slope")


def test_losses(spark):
    rng = np.random.default_rng(0)
    n = 50
    p, t, c = rng.uniform(-2, 3, n), rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    z, y, w = rng.normal(size=(n, 5)) * 3, rng.integers(0, 4, n), np.array([0.5, 1.0, 2.0, 4.0])
    rows = [(float(a), float(b), float(d), int(k), [float(v) for v in l]) for a, b, d, k, l in zip(t, p, c, y, z)]
    df = spark.createDataFrame(rows, "risk double, risk_pred double, confidence double, event_class int, logits array<double>")
    d = np.abs(p - t)
    risk = (np.where(d < 1, 0.5 * d * d, d - 0.5) * c).mean()
    cross = np.log(np.exp(z[:, :4]).sum(1)) - z[np.arange(n), y]
    got = views.losses(df, w.tolist(), 2.0, 0.5).first()
    assert (got["loss_risk"], got["loss_event_class"]) == pytest.approx((risk, (w[y] * cross).sum() / w[y].sum()))
    assert got["loss"] == pytest.approx(2 * risk + 0.5 * got["loss_event_class"])
    assert views.losses(df).first()["loss_event_class"] == pytest.approx(cross.mean())


def test_overlap_counts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), a := rng.randint(0, 60), a + rng.choice([0, 0, 3, 40])) for i in range(120)]
    for width in (1.0, 7.0, 1000.0):
        got = {r["i"]: r["n"] for r in views.overlap_counts(spark.createDataFrame(rows, "i int, g string, lo int, hi int"), ["g"], "lo", "hi", "i", width).collect()}
        assert got == {i: sum(h == g and c <= b and a <= e for j, h, c, e in rows if j != i) for i, g, a, b in rows}


def test_voxel_corridor_is_a_radius_search(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(-20, 20, (3000, 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    o = spark.createDataFrame([(1, 1.0, 2.0, 0.6, 0.8), (2, 300.0, 300.0, 1.0, 0.0)], "tr_id int, ox double, oy double, nx double, ny double")
    got = {(r["tr_id"], r["id"]) for r in views.voxel_corridor(pts, o, 9.0, 2.0, 2.0, 3).collect()}
    n = int(9 / 2.0) + 1
    spots = np.array([1, 2]) + np.linspace(-9, 9, 2 * n - 1)[:, None] * np.array([0.6, 0.8])
    along, across = (xy - [1, 2]) @ [0.6, 0.8], np.abs((xy - [1, 2]) @ [0.8, -0.6])
    near = (np.hypot(*(xy[:, None] - spots).transpose(2, 0, 1)) <= 1).any(1) & (across <= 1) & (np.abs(along) <= 9)
    assert got == {(1, int(i)) for i in np.flatnonzero(near)} and len(got) > 20


def test_voxel_corridor_border_is_judged_from_the_origin(spark):
    o = spark.createDataFrame([(1, 50.0, 5.0, 0.8, 0.6)], "tr_id int, ox double, oy double, nx double, ny double")
    rows = [(50 + s * 2.5 + 4.0 * m, 5.0 + 3 * m) for s in (-1, 1) for m in range(-5, 6)]  # 1.5 from the line, beside a sample, but for rounding
    points = spark.createDataFrame(rows, "x double, y double")

    def inside(x, y):
        d, p = (x - 50) * 0.8 + (y - 5) * 0.6, abs((x - 50) * 0.6 - (y - 5) * 0.8)
        return -30 <= d <= 30 and p <= 1.5 and (d - round(d)) ** 2 + p**2 <= 2.25

    want = sorted(r for r in rows if inside(*r))
    assert sorted((r["x"], r["y"]) for r in views.voxel_corridor(points, o, 30.0, 3.0, 1.0).collect()) == want
    assert 0 < len(want) < len(rows)


def test_climate_files_by_header_and_older_ones(spark, tmp_path):
    junk = ["about"] * 10
    (tmp_path / "a.csv").write_text("\n".join([*junk, "Name,Longitude,Latitude,Elevation (m),Date,ppt (mm),tmin (degrees C),tmean (degrees C),tmax (degrees C),tdmean (degrees C)", "blacks,-117,32,10,2023-01-01,1.5,2,3,4,1"]))
    (tmp_path / "b.csv").write_text("\n".join([*junk[:4], "Name,Date,tmax (degrees C),ppt (mm),vpdmax (hPa)", "torrey,2023-01-02,9,0.25,7", "torrey,,1,1,1"]))
    got = {r["name"]: r for r in files.read_climate_bulk(spark, str(tmp_path)).collect()}
    assert set(got) == {"blacks", "torrey"} and (got["blacks"]["precip_mm"], got["blacks"]["temp_mean_c"]) == (1.5, 3)
    assert (got["torrey"]["precip_mm"], got["torrey"]["temp_max_c"], got["torrey"]["vpdmax_hpa"], got["torrey"]["lat"]) == (0.25, 9, 7, None)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "delmar_raw.csv").write_text("date,ppt,tmean\n2020-01-01,3.5,11\n2020-01-02,,12\n")
    rows = files.read_climate_legacy(spark, str(tmp_path / "old")).orderBy("date").collect()
    assert [(r["beach"], r["precip_mm"], r["temp_mean_c"]) for r in rows] == [("delmar", 3.5, 11), ("delmar", None, 12)]
