"""The grid-sorted store, Morton codes, segmented line queries and the sampled corridor."""

import random
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as g
from tidemark.operators import joins, segments
from tidemark.sources import pointstore


def cloud(spark, n=40_000):
    """Points over 400 x 400 m; a third of them in one cell."""
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 400, (n, 2))
    xy[: n // 3] = 100.25 + rng.uniform(0, 0.5, (n // 3, 2))
    rows = [(int(i), float(x), float(y), float(i % 11), float(i % 5)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, intensity double")


def test_morton(spark):
    rng = random.Random(1)
    cells = [(rng.randrange(1 << 31), rng.randrange(1 << 31)) for _ in range(50)] + [(0, 0), (1, 0), (0, 1), ((1 << 31) - 1, (1 << 31) - 1)]
    got = spark.createDataFrame(cells, "a long, b long").select("a", "b", g.morton(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        assert r["m"] == sum((r["a"] >> i & 1) << 2 * i | (r["b"] >> i & 1) << 2 * i + 1 for i in range(31)) == pointstore._corner(r["a"], r["b"])


def test_store_prunes_files_and_row_groups(spark, tmp_path):
    points, path = cloud(spark), str(tmp_path / "store")
    pointstore.write_points(points, path, cell=4.0, file_rows=4000, row_group=16_384)
    box = (200.0, 300.0, 230.0, 325.0)
    want = points.where("x between 200 and 230 and y between 300 and 325")
    got = pointstore.read_points(spark, path, box)
    assert got.columns == points.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    files = [urlparse(r["path"]).path for r in pointstore.manifest(spark, path).collect()]
    opened = [urlparse(f).path for f in pointstore.files_in(spark, path, box)]
    assert set(opened) <= set(files) and len(opened) <= len(files) / 3
    groups, read = 0, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for k in range(meta.num_row_groups):
            x, y = (meta.row_group(k).column(names.index(c)).statistics for c in "xy")
            groups += 1
            read += f in opened and x.max >= 200 and x.min <= 230 and y.max >= 300 and y.min <= 325
    assert groups >= 40 and 0 < read < groups / 10
    most = max(r["n"] for r in pointstore.manifest(spark, path).collect())
    assert most < 8000  # the crowded cell is dealt over several files
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(x,23" in plan  # the rest is cut off


def test_store_of_odd_points(spark, tmp_path):
    rows = [(1, -5.0, -7.5, None, 0.0), (2, None, 3.0, 1.0, 1.0), (3, -5.0, -7.5, None, 0.0), (4, 1e6, 2e6, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, intensity double")
    pointstore.write_points(points, str(tmp_path / "a"))
    assert pointstore.read_points(spark, str(tmp_path / "a")).count() == 4
    assert {r["id"] for r in pointstore.read_points(spark, str(tmp_path / "a"), (-9.0, -9.0, 0.0, 0.0)).collect()} == {1, 3}
    assert pointstore.read_points(spark, str(tmp_path / "a"), (50.0, 50.0, 60.0, 60.0)).count() == 0
    pointstore.write_points(points.limit(0), str(tmp_path / "b"))
    assert pointstore.read_points(spark, str(tmp_path / "b"), (0.0, 0.0, 1.0, 1.0)).count() == 0
    with pytest.raises(ValueError, match="cells"):
        pointstore.write_points(points, str(tmp_path / "c"), cell=1e-6)


def test_segments(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 0.0), (2, 0.0, 0.0, 30.0, 40.0)], "tr_id int, x0 double, y0 double, x1 double, y1 double")
    boxes = segments.segment_boxes(lines, 2.0).orderBy("tr_id", "segment").collect()
    assert [(r["tr_id"], r["segment"]) for r in boxes] == [(1, 0), (2, 0), (2, 1), (2, 2)]
    assert (boxes[0]["xmin"], boxes[0]["xmax"], boxes[2]["xmin"], boxes[2]["xmax"]) == (-2, 42, pytest.approx(8), pytest.approx(22))
    rows = [(20.0, 0.5, 1.0, 4.0), (20.0, 0.5, 1.0, 2.0), (20.0, 0.5, 1.0, 2.0), (12.0, 16.0, 1.0, 8.0), (12.0, 16.0, 1.0001, 6.0), (500.0, 0.0, 0.0, 99.0)]
    points = spark.createDataFrame(rows, "x double, y double, z double, intensity double")
    got = segments.points_by_segments(points, lines, 1.0, ["intensity"])
    # one box keeps repeats, several boxes keep the first of a place
    assert sorted((r["tr_id"], r["x"], r["intensity"]) for r in got.collect()) == [(1, 20, 0.5), (1, 20, 0.5), (1, 20, 1.0), (2, 12, 1.0)]


def test_segments_lose_no_point_of_the_corridor(spark):
    rng = random.Random(2)
    lines = spark.createDataFrame([(i, *(rng.uniform(0, 400) for _ in range(4))) for i in range(6)], "tr_id int, x0 double, y0 double, x1 double, y1 double")
    points = cloud(spark, 20_000)
    near = segments.points_by_segments(points.drop("intensity"), lines, 2.0, ["id"]).join(lines, "tr_id")
    got = {(r["tr_id"], r["id"]) for r in joins.corridor_of(near, 2.0).collect()}
    want = {(r["tr_id"], r["id"]) for r in joins.corridor_join(points, lines, 2.0, 8.0).collect()}
    assert got == want and len(want) > 100


def test_sampled_corridor_is_the_union_of_balls(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "tr_id int, x0 double, y0 double, x1 double, y1 double")
    points = cloud(spark, 20_000).selectExpr("id", "x / 4 as x", "y / 20 - 10 as y")
    got = {r["id"] for r in joins.corridor_join(points, lines, 5.0, 8.0, mode="sampled").collect()}
    n = max(int(100 / 2.5), 10)
    spots = np.linspace(0, 100, n)
    want = {r["id"] for r in points.collect() if 0 <= r["x"] <= 100 and abs(r["y"]) <= 5 and (np.hypot(spots - r["x"], r["y"]) <= 5).any()}
    assert got == want and want


def test_sampled_corridor_ends_where_the_last_ball_ends(spark):
    lines = spark.createDataFrame([(1, 0.0, 5.0, 100.0, 8.0), (2, 30.0, 2.0, 30.0, 2.0)], "tr_id int, x0 double, y0 double, x1 double, y1 double")
    xs = [99.9999, 99.99999, 100.0, 100.00001, 100.00005, 100.01]  # 6 below the end of line 1: only x = 100 lies in the ball
    points = spark.createDataFrame([(x, 2.0) for x in xs] + [(33.0, 2.0)], "x double, y double")
    got = joins.corridor_join(points, lines, 6.0, 8.0, mode="sampled")
    assert sorted((r["tr_id"], r["x"]) for r in got.collect()) == [(1, 33.0), (1, 100.0), (2, 33.0)]


def test_segments_round_places_as_doubles_lie(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "tr_id int, x0 double, y0 double, x1 double, y1 double")
    # 2.0035 * 1000 is a little under 2003.5, so both share a place
    points = spark.createDataFrame([(2.0035, 0.0, 0.0, 1), (2.003, 0.0, 0.0, 2)], "x double, y double, z double, id int")
    assert [r["id"] for r in segments.points_by_segments(points, lines, 1.0, ["id"]).collect()] == [1]
