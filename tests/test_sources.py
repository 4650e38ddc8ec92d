import io
import math
import struct

import numpy as np
import pytest
from test_fits import redfearn

from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan

from tidemark.sources import files, npz, sinks
from tidemark.sources import las as sources_las


def las(points, form=0):
    """A LAS 1.2 file of (x, y, z, intensity, class)."""
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<IIBHI", head, 96, 227, 0, form, 20, len(points))
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.01)
    xyz = np.array([p[:3] for p in points])
    struct.pack_into("<6d", head, 179, *[v for k in range(3) for v in (xyz[:, k].max(), xyz[:, k].min())])
    body = b"".join(struct.pack("<iiiHBBbBH", round(x * 100), round(y * 100), round(z * 100), i, 1 | 1 << 3, c, 0, 0, 0) for x, y, z, i, c in points)
    return bytes(head) + body


def test_las(spark, tmp_path):
    (tmp_path / "20180101_a.las").write_bytes(las([(1, 2, 3, 10, 2), (4, 5, 6, 20, 5), (90, 5, 6, 80, 5)]))
    rows = files.read_las(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r["x"], r["classification"], r["num_returns"]) for r in rows] == [(1, 2, 1), (4, 5, 1), (90, 5, 1)]
    assert [round(r["intensity"], 4) for r in rows] == [0.125, 0.25, 1]
    kept = files.read_las(spark, str(tmp_path), bounds=(0, 0, 10, 10)).orderBy("x").collect()
    assert [round(r["intensity"], 4) for r in kept] == [0.5, 1]
    (tmp_path / "broken.las").write_bytes(b"nothing")
    h = {r["las_source"]: r for r in files.read_las_headers(spark, str(tmp_path)).collect()}
    assert h["20180101_a.las"]["n_points"] == 3 and h["20180101_a.las"]["xmax"] == 90 and h["broken.las"]["n_points"] is None
    ok = {r["path"].split("/")[-1]: r["has_magic"] for r in files.integrity(spark, str(tmp_path)).collect()}
    assert ok == {"20180101_a.las": True, "broken.las": False}


def test_las_in_ranges_and_by_box(spark, tmp_path):
    rows = [(i % 100, i // 100, i % 7, i % 50, 2) for i in range(10_000)]
    (tmp_path / "a.las").write_bytes(las(rows))
    (tmp_path / "far.las").write_bytes(las([(900, 900, 0, 5, 2)]))
    df = files.read_las(spark, str(tmp_path), normalise=False, split=20_000)
    assert df.rdd.getNumPartitions() > 8
    assert sorted((r["x"], r["y"], r["intensity"]) for r in df.where("las_source = 'a.las'").collect()) == sorted((x, y, i) for x, y, _, i, _ in rows)
    box = files.read_las(spark, str(tmp_path), bounds=(10, 20, 12, 30), normalise=False, split=20_000)
    assert {(r["x"], r["y"]) for r in box.collect()} == {(x, y) for x in (10, 11, 12) for y in range(20, 31)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("las").option("pushdown", "true").load(str(tmp_path)).where("x >= 10 and x < 12 and y > 98")
    assert sorted((r["x"], r["y"]) for r in pushed.collect()) == [(10, 99), (11, 99)]
    reader = sources_las.PushingLasReader({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("x",), 10), LessThan(("x",), 12), GreaterThan(("y",), 98)]))) == 3
    assert reader.box == (10, 98, 12, np.inf)
    assert files.extent(df).first() == (0, 900, 0, 900)


def test_las_beyond_two_gigabytes_and_records(spark, tmp_path):
    head = bytearray(las([(1, 2, 3, 10, 2), (4, 5, 6, 20, 5)]))
    body, at = bytes(head[227:]), 3_000_000_000
    struct.pack_into("<HII", head, 94, 227, at, 1)
    with open(tmp_path / "large.las", "wb") as f:  # a sparse file
        f.write(head[:227] + struct.pack("<2x16sHH32x", b"copc", 1, 160))
        f.seek(at)
        f.write(body)
    assert sorted(r["x"] for r in files.read_las(spark, str(tmp_path), split=1 << 30).collect()) == [1, 4]
    (row,) = files.read_las_headers(spark, str(tmp_path)).collect()
    assert row["indexed"] and row["n_points"] == 2
    (tmp_path / "b.copc.laz").write_bytes(b"LASF")
    assert {r["las_source"]: r["indexed"] for r in files.read_las_headers(spark, str(tmp_path)).collect()} == {"large.las": True, "b.copc.laz": True}


def test_las_headers_read_no_points(tmp_path):
    (tmp_path / "a.las").write_bytes(las([(1, 2, 3, 10, 2)] * 5000))
    with sources_las.opened(str(tmp_path / "a.las")) as f:
        h = sources_las.header(f.read(sources_las.HEADER))
        assert list(sources_las.records(f, h)) == [] and f.tell() == 375
    assert not sources_las._overlaps(h, (50, 50, 60, 60)) and h["count"] == 5000


def test_versions(spark):
    paths = ["a.las", "a.laz", "a.copc.laz", "b.las", "c.txt"]
    got = files.preferred_versions(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r["path"] for r in got.collect()) == ["a.copc.laz", "b.las"]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "x.npz", points=np.array([[1.0, np.nan], [3.0, 4.0]]))
    rows = files.read_npz(spark, str(tmp_path), "points").orderBy("index").collect()
    assert [r["values"] for r in rows] == [[1.0, None], [3.0, 4.0]]
    back = np.load(io.BytesIO(sinks.to_npz(spark.createDataFrame([(1, "a", [1.0, 2.0])], "k int, s string, v array<double>"))))
    assert back["v"].tolist() == [[1.0, 2.0]] and back["s"].tolist() == ["a"]


def test_kml(spark, tmp_path):
    (tmp_path / "t.kml").write_text(
        "<kml><Document><Placemark><name>MOP 1</name><LineString><coordinates>-117.2,32.9,0 -117.1,32.9,5</coordinates></LineString></Placemark>"
        "<Placemark><name>p</name><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>"
    )
    (row,) = files.read_kml(spark, str(tmp_path / "t.kml")).collect()
    assert row["name"] == "MOP 1" and row["lon1"] == -117.1 and row["x1"] - row["x0"] == pytest.approx(0.1 * 111320 * np.cos(np.radians(32.9)))


def test_shapefile(spark, tmp_path):
    xy = [(0.0, 0.0), (3.0, 1.0), (3.0, 4.0)]
    body = struct.pack("<i4dii", 3, 0, 0, 3, 4, 1, 3) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in xy)
    (tmp_path / "l.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"tr_id".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4, 0]) + bytes(14)
    (tmp_path / "l.dbf").write_bytes(bytes([3, 0, 0, 0]) + struct.pack("<IHH", 1, 65, 5) + bytes(20) + field + b"\r" + b" T07 ")
    (row,) = files.read_shapefile(spark, str(tmp_path)).collect()
    assert (row["name"], row["x1"], row["y1"], row["length"]) == ("T07", 3, 4, 5)


def test_climate_bulk_and_events(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\n".join(["junk"] * 10 + ["header", "blacks,-117,32,10,2023-01-01,1.5,2,3,4,1", "torrey,-117,32,10,2023-01-02,,2,3,4,1", ""]))
    rows = files.read_climate_bulk(spark, str(tmp_path / "p.csv")).orderBy("date").collect()
    assert [(r["name"], r["precip_mm"]) for r in rows] == [("blacks", 1.5), ("torrey", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "beach string, v int")
    sinks.write_by(df, str(tmp_path / "o"), "beach")
    assert sorted(p.name for p in (tmp_path / "o").glob("beach=*")) == ["beach=a", "beach=b"]
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lines = sinks.report_lines(spark.createDataFrame([("dates", "info", "ok"), ("ids", "error", "2 twice")], "check string, severity string, message string"))
    assert [r[0] for r in lines.collect()] == ["[ERROR] ids: 2 twice", "[INFO] dates: ok"]


def test_npz_of_over_a_million_rows_by_tasks(spark, tmp_path):
    n, path = 1_200_000, str(tmp_path / "out")
    df = spark.range(n, numPartitions=5).selectExpr("id", "id % 7 as k", "case when id % 5 <> 0 then id / 2.0D end as v", "concat('n', id % 3) as s", "array(id * 1.0D, 2.0D) as pair")
    sinks.write_npz(df, path, rows=100_000)
    listed = npz.manifest(path)
    assert sum(r for _, r in listed) == n and len(listed) >= 12 and max(r for _, r in listed) <= 100_000
    back = files.read_npz_table(spark, path, "id long, k long, v double, s string, pair array<double>")
    got = back.selectExpr("count(*)", "count(distinct id)", "sum(id)", "sum(k)", "sum(if(isnan(v), 0, v))", "count_if(s = 'n1')", "sum(pair[0] - id)").first()
    want = df.selectExpr("count(*)", "count(distinct id)", "sum(id)", "sum(k)", "sum(v)", "count_if(s = 'n1')", "0.0D").first()
    assert tuple(got) == pytest.approx(tuple(want))


def test_npz_object_arrays_are_opened_but_never_run(spark, tmp_path):
    class Evil:
        def __reduce__(self):
            return (open, (str(tmp_path / "ran"), "w"))

    np.savez(tmp_path / "a.npz", name=np.array(["MOP 1", None, "MOP 1", "é"], object), n=np.array([1, 2.5, None, 4], object), x=np.arange(8.0).reshape(4, 2), t=np.array(["a", "b", "c", "d"]))
    rows = files.read_npz_table(spark, str(tmp_path), "name string, n double, x array<double>, t string, none int").orderBy("index").collect()
    assert [(r["name"], r["n"], r["x"], r["t"], r["none"]) for r in rows] == [("MOP 1", 1, [0, 1], "a", None), (None, 2.5, [2, 3], "b", None), ("MOP 1", None, [4, 5], "c", None), ("é", 4, [6, 7], "d", None)]
    np.savez(tmp_path / "a.npz", name=np.array([Evil()], object))
    with pytest.raises(Exception, match="is not opened"):
        files.read_npz_table(spark, str(tmp_path), "name string").collect()
    assert not (tmp_path / "ran").exists()
    assert files.npz_arrays((tmp_path / "a.npz").read_bytes(), ["missing"]) == {}


def test_projected_lines(spark, tmp_path):
    def shape(stem, a, b, prj=None):
        body = struct.pack("<i4dii", 3, *a, *b, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", *a, *b)
        (tmp_path / f"{stem}.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
        if prj:
            (tmp_path / f"{stem}.prj").write_text(prj)

    ll = ((-117.25, 32.95), (-117.26, 32.96))
    shape("lonlat", *ll, 'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983"]]')
    names = [r["name"] for r in files.read_shapefile(spark, str(tmp_path)).collect()]
    metres = files.read_shapefile(spark, str(tmp_path), zone=11).first()
    assert names == ["0"] and (metres["x0"], metres["y0"]) == pytest.approx(redfearn(*ll[0], 11), abs=2e-3) and metres["crs"] == "utm11n"
    at = lambda r: (r["x0"], r["y0"], r["x1"], r["y1"])
    shape("same", at(metres)[:2], at(metres)[2:], 'PROJCS["NAD_1983_UTM_Zone_11N",GEOGCS["x"]]')
    shape("none", at(metres)[:2], at(metres)[2:])
    other = files.reproject(files.read_shapefile(spark, str(tmp_path / "lonlat*")), 12).first()
    shape("zone12", at(other)[:2], at(other)[2:], 'PROJCS["NAD_1983_UTM_Zone_12N",GEOGCS["x"]]')
    for r in files.read_shapefile(spark, str(tmp_path), zone=11).collect():
        assert at(r) == pytest.approx(at(metres), abs=1e-3) and r["length"] == pytest.approx(metres["length"], abs=1e-3)
    (tmp_path / "t.kml").write_text(
        "<kml><Document><Placemark><name>MOP 1</name><LineString><coordinates>-117.25,32.95,3 -117.255,32.955 -117.26,32.96,5</coordinates></LineString></Placemark>"
        "<Placemark><LineString><coordinates>-117.2,32.9 -117.3,32.9</coordinates></LineString></Placemark><Placemark><name>one</name><LineString><coordinates>1,2</coordinates></LineString></Placemark></Document></kml>"
    )
    a, b = files.read_kml(spark, str(tmp_path / "t.kml"), zone=11).orderBy("name").collect()
    assert at(a) == pytest.approx(at(metres), abs=1e-3) and (a["z0"], a["z1"], b["name"], b["z1"]) == (3, 5, "Unnamed", 0)
    assert a["nx"] == pytest.approx((a["x1"] - a["x0"]) / a["length"]) and math.hypot(a["nx"], a["ny"]) == pytest.approx(1)
