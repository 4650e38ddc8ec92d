"""Readers of binary and text formats.

Files are opened by Spark (``binaryFile``, ``text``, ``csv``, ``xml``), so any
store that Spark reaches will do, and parsed in tasks; point clouds, which may
be larger than a row, by the ``las`` data source.
"""

from __future__ import annotations

import io
import pickle
import re
import struct
import zipfile
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from . import las

def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_las(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, normalise: bool = True, split: int = las.SPLIT) -> DataFrame:
    """Points of uncompressed LAS files; with bounds (closed) only those within, which tasks leave out before they parse them.

    Intensities are divided by the greatest of each file's kept points, or left
    where that is 0.
    """
    spark.dataSource.register(las.LasSource)
    reader = spark.read.format("las").option("split", split)
    points = (reader.option("bounds", ",".join(repr(float(b)) for b in bounds)) if bounds else reader).load(path).drop("point")
    if normalise:
        top = points.groupBy("las_source").agg(F.max("intensity").alias("_top"))
        points = points.join(F.broadcast(top), "las_source")  # a row a file
        points = points.withColumn("intensity", (F.col("intensity") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)).cast("float")).drop("_top")
    return points


_HEADERS = "las_source string, n_points long, point_format int, compressed boolean, indexed boolean, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double"


def read_las_headers(spark: SparkSession, path: str) -> DataFrame:
    """las_source, n_points, point_format, compressed, indexed and bounds of each file; unreadable files keep nulls.

    Only headers are read: 375 bytes and 54 for each variable-length record.  A
    file is ``indexed`` where its name has ``.copc.`` or a record's user is ``copc``.
    """

    def parse(batches):
        for b in batches:
            rows = []
            for name, place in zip(b["name"], b["path"]):
                named = ".copc." in name.lower()
                try:
                    with las.opened(place) as file:
                        h = las.header(file.read(las.HEADER))
                        user = any(u.lower() == "copc" for u, _, _ in las.records(file, h))
                    rows.append((name, h["count"], h["format"], h["compressed"], named or user, *h["bounds"]))
                except (ValueError, struct.error):
                    rows.append((name, None, None, None, named, *[None] * 6))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HEADERS.split(", ")])

    listed = [(p, p.rsplit("/", 1)[-1]) for p, _ in las.listing(path, "*.la[sz]")]  # a row a file
    files = spark.createDataFrame(listed, "path string, name string").repartition(max(1, min(len(listed), 200)))
    return files.mapInPandas(parse, _HEADERS)


def extent(points: DataFrame) -> DataFrame:
    """xmin, xmax, ymin, ymax of all points read, one row."""
    return points.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def integrity(spark: SparkSession, path: str, magic: bytes = b"LASF", least_bytes: int = 375) -> DataFrame:
    """path, n_bytes, has_magic, big_enough, md5 of each file."""
    f = binary(spark, path)
    return f.select("path", F.col("length").alias("n_bytes"), (F.substring("content", 1, len(magic)) == F.lit(magic)).alias("has_magic"), (F.col("length") >= least_bytes).alias("big_enough"), F.md5("content").alias("md5"))


def preferred_versions(listing: DataFrame, path: str = "path") -> DataFrame:
    """Of files with one stem the best version: ``.copc.laz``, then ``.laz``, then ``.las``."""
    p = F.col(path)
    rank = F.when(p.endswith(".copc.laz"), 0).when(p.endswith(".laz"), 1).when(p.endswith(".las"), 2)
    stem = F.regexp_replace(p, r"(?:\.copc)?\.la[sz]$", "")
    return listing.withColumn("_rank", rank).where("_rank is not null").groupBy(stem.alias("stem")).agg(F.min_by(path, "_rank").alias(path))


def _dbf(content: bytes) -> list[dict]:
    n, start, size = struct.unpack_from("<IHH", content, 4)
    fields, at, offset = [], 32, 1
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, offset, content[at + 16]))
        offset += content[at + 16]
        at += 32
    rows = []
    for i in range(n):
        raw = content[start + i * size : start + (i + 1) * size]
        rows.append({f: raw[o : o + w].decode("latin-1").strip() for f, o, w in fields})
    return rows


NAME_FIELDS = ("name", "Name", "NAME", "id", "ID", "FID", "tr_id")


def coordinate_system(prj: str | None) -> str:
    """``lonlat``, ``utm11n`` and the like, or ``unknown``, of the text beside a shapefile."""
    text = (prj or "").strip()
    zone = re.search(r"UTM[ _]zone[ _](\d+)([NS])", text, re.IGNORECASE)
    if zone and not text.upper().startswith("GEOGCS"):
        return f"utm{int(zone[1])}{zone[2].lower()}"
    return "lonlat" if text.upper().startswith(("GEOGCS", "GEOGCRS")) else "unknown"


def reproject(lines: DataFrame, zone: int, south: bool = False, ellipsoid: tuple[float, float] = projection.GRS80) -> DataFrame:
    """Lines (crs, x0, y0, x1, y1) in metres of one UTM zone, with nx, ny and length anew.

    Degrees and metres of other zones are converted; an unknown system is taken
    as the zone's own, as a file without one is.
    """
    target, out = f"utm{zone}{'s' if south else 'n'}", lines
    crs = F.col("crs")
    other = F.regexp_extract(crs, r"utm(\d+)", 1).try_cast("int")
    for a, b in (("x0", "y0"), ("x1", "y1")):
        above = F.col(b) - F.when(crs.endswith("s"), projection.SOUTH).otherwise(0.0)
        degrees = projection.from_utm(F.col(a), above, other, ellipsoid=ellipsoid)
        # in columns of their own, so that the series stands once in the plan
        out = out.withColumns({f"_{c}": F.when(crs == "lonlat", F.col(c)).otherwise(v) for c, v in zip((a, b), degrees)})
        x, y = projection.to_utm(F.col(f"_{a}"), F.col(f"_{b}"), zone, south, ellipsoid)
        keep = crs.isin(target, "unknown")
        out = out.withColumns({a: F.when(keep, F.col(a)).otherwise(x), b: F.when(keep, F.col(b)).otherwise(y)})
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    out = out.withColumns({"length": size, "nx": -(F.col("y1") - F.col("y0")) / (size + 1e-8), "ny": (F.col("x1") - F.col("x0")) / (size + 1e-8)})
    return out.withColumn("crs", F.lit(target)).select(lines.columns)


def read_shapefile(spark: SparkSession, path: str, zone: int | None = None, south: bool = False) -> DataFrame:
    """name, x0, y0, x1, y1, nx, ny, length, crs of each line: first and last vertex; other shapes are left out.

    The name is the first of the usual name fields that isn't empty, else the
    record's number.  With a zone the lines are converted to its metres, from
    the coordinate system that the ``.prj`` file names.
    """

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {p.rsplit(".", 1)[-1].lower(): bytes(c) for p, c in zip(pdf["path"], pdf["content"])}
        shp, rows = parts.get("shp"), []
        names = _dbf(parts["dbf"]) if "dbf" in parts else []
        crs = coordinate_system(parts.get("prj", b"").decode("utf-8", "replace"))
        at, i = 100, 0
        while shp and at + 12 <= len(shp):
            words, kind = struct.unpack_from(">i", shp, at + 4)[0], struct.unpack_from("<i", shp, at + 8)[0]
            if kind in (3, 13, 23):
                n_parts, n = struct.unpack_from("<ii", shp, at + 44)
                xy = np.frombuffer(shp, "<f8", 2 * n, at + 52 + 4 * n_parts).reshape(-1, 2)
                record = names[i] if i < len(names) else {}
                name = next((record[f] for f in NAME_FIELDS if record.get(f)), str(i))
                (x0, y0), (x1, y1) = xy[0], xy[-1]
                size = float(np.hypot(x1 - x0, y1 - y0))
                rows.append((name, x0, y0, x1, y1, -(y1 - y0) / (size + 1e-8), (x1 - x0) / (size + 1e-8), size, crs))
            at, i = at + 8 + 2 * words, i + 1
        return pd.DataFrame(rows, columns=["name", "x0", "y0", "x1", "y1", "nx", "ny", "length", "crs"])

    f = binary(spark, path, "*.{shp,dbf,prj}").withColumn("stem", F.regexp_replace("path", r"\.(?:shp|dbf|prj)$", ""))
    lines = f.groupBy("stem").applyInPandas(parse, "name string, x0 double, y0 double, x1 double, y1 double, nx double, ny double, length double, crs string")
    return lines if zone is None else reproject(lines, zone, south)


def read_kml(spark: SparkSession, path: str, zone: int | None = None, south: bool = False) -> DataFrame:
    """name, lon0, lat0, z0, lon1, lat1, z1, x0, y0, x1, y1, nx, ny, length of each Placemark's line of two places or more.

    Metres are those of a UTM zone, or without one an equirectangular projection
    about the file's mean start.  A height that isn't given is 0, a name "Unnamed".
    """
    schema = "name string, LineString struct<coordinates: string>"
    k = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path).where("LineString.coordinates is not null")
    spots = F.filter(F.split(F.trim("LineString.coordinates"), r"\s+"), lambda s: s != "")
    part = lambda s, i: F.get(F.split(s, ","), F.lit(i)).try_cast("double")
    ends = k.select(F.coalesce("name", F.lit("Unnamed")).alias("name"), spots.alias("_s")).where(F.size("_s") >= 2)
    ends = ends.select("name", F.element_at("_s", 1).alias("a"), F.element_at("_s", -1).alias("b"))
    place = lambda c, n: [part(F.col(c), 0).alias(f"lon{n}"), part(F.col(c), 1).alias(f"lat{n}"), F.coalesce(part(F.col(c), 2), F.lit(0.0)).alias(f"z{n}")]
    ends = ends.select("name", *place("a", 0), *place("b", 1))
    if zone is None:
        mid = ends.agg(F.avg("lon0").alias("_lon"), F.avg("lat0").alias("_lat"))
        metre = 111_320.0
        x = lambda c: (F.col(c) - F.col("_lon")) * metre * F.cos(F.radians("_lat"))
        y = lambda c: (F.col(c) - F.col("_lat")) * metre
        lines = ends.join(F.broadcast(mid)).select(*ends.columns, x("lon0").alias("x0"), y("lat0").alias("y0"), x("lon1").alias("x1"), y("lat1").alias("y1"))  # one row
    else:
        metres = [c.alias(f"{a}{n}") for n in "01" for a, c in zip("xy", projection.to_utm(F.col(f"lon{n}"), F.col(f"lat{n}"), zone, south))]
        lines = ends.select(*ends.columns, *metres)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.hypot(dx, dy)
    return lines.select(*lines.columns, (dx / (size + 1e-8)).alias("nx"), (dy / (size + 1e-8)).alias("ny"), size.alias("length"))


class _PlainObjects(pickle.Unpickler):
    """Opens object arrays of texts, numbers and nulls; whatever names any other class or function is refused."""

    #: What numpy writes for an array, by its old and new module names.
    ALLOWED = {(m, n) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for n in ("_reconstruct", "scalar")} | {("numpy", "ndarray"), ("numpy", "dtype")}

    def find_class(self, module, name):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"an object array that names {module}.{name} is not opened")
        return super().find_class(module, name)


def _open_array(stored) -> np.ndarray:
    """An array of an NPZ member, of plain values only."""
    version = np.lib.format.read_magic(stored)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(stored) if version == (1, 0) else np.lib.format.read_array_header_2_0(stored)
    if kind.hasobject:
        return np.asarray(_PlainObjects(stored).load(), object).reshape(shape)
    flat = np.frombuffer(stored.read(), kind, int(np.prod(shape, dtype=np.int64)))
    return flat.reshape(shape, order="F" if fortran else "C")


def npz_arrays(content: bytes, wanted: list[str]) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        return {a: _open_array(io.BytesIO(z.read(f"{a}.npy"))) for a in wanted if f"{a}.npy" in names}


def read_npz(spark: SparkSession, path: str, array: str) -> DataFrame:
    """path, index, values: rows of one array of numbers of NPZ files along its first axis."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                for a in npz_arrays(bytes(content), [array]).values():
                    a = np.atleast_1d(a)
                    flat = a.reshape(len(a), -1).astype(float)
                    for lo in range(0, len(flat), 10_000):
                        part = flat[lo : lo + 10_000]
                        yield pd.DataFrame({"path": name, "index": np.arange(lo, lo + len(part)), "values": list(part)})

    rows = binary(spark, path, "*.npz").select("path", "content").mapInPandas(parse, "path string, index long, values array<double>")
    return rows.withColumn("values", F.transform("values", lambda v: F.when(~F.isnan(v), v)))


def read_npz_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of NPZ files whose arrays of one length are columns; path, index and the columns of ``schema`` (name type, ...).

    Object arrays of texts, numbers and nulls are read without running what they
    name; an array of several axes is an array column of its row's values.
    """
    fields = [c.strip().split(maxsplit=1) for c in schema.split(",")]

    def parse(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                found = {k: np.atleast_1d(a) for k, a in npz_arrays(bytes(content), [f for f, _ in fields]).items()}
                n = max(map(len, found.values()), default=0)
                for lo in range(0, n, 10_000):
                    hi = min(n, lo + 10_000)
                    columns = {"path": name, "index": np.arange(lo, hi)}
                    for f, _ in fields:
                        a = found.get(f)
                        columns[f] = [None] * (hi - lo) if a is None else [v.ravel().tolist() if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else v for v in a[lo:hi]]
                    yield pd.DataFrame({c: pd.Series(v, dtype=object) if isinstance(v, list) else v for c, v in columns.items()})

    return binary(spark, path, "*.npz").select("path", "content").mapInPandas(parse, f"path string, index long, {schema}")


#: The measures' names in bulk exports (before the unit) and in the older files.
CLIMATE_NAMES = {"ppt": "precip_mm", "tmin": "temp_min_c", "tmean": "temp_mean_c", "tmax": "temp_max_c", "tdmean": "dewpoint_c", "vpdmin": "vpdmin_hpa", "vpdmax": "vpdmax_hpa"}
_BULK = ("name", "lon", "lat", "elevation_m", "date", "precip_mm", "temp_min_c", "temp_mean_c", "temp_max_c", "dewpoint_c")


def _bulk_columns(header: str) -> list[str]:
    """Our names of a bulk file's columns, by its header line."""
    known = {"name": "name", "longitude": "lon", "latitude": "lat", "elevation": "elevation_m", "date": "date", **CLIMATE_NAMES}
    return [known.get(re.sub(r"\s*\(.*", "", c.strip().lower()), f"_{i}") for i, c in enumerate(header.split(","))]


def read_climate_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Bulk climate CSVs below some lines of description: name, lon, lat, elevation_m, date and measures, missing values null.

    Columns are found by the header that each file has, which names Name and
    Date; files of one header are read together, split as CSV is.  A file without
    one has the usual order.  What isn't a row with a date is left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    names_it = lambda c: F.lower("value").rlike(rf"(^|,)\s*{c}\s*(,|$)")
    heads = lines.where(names_it("name") & names_it("date")).groupBy("file").agg(F.min("value").alias("head"))
    layouts = lines.select("file").distinct().join(heads, "file", "left").groupBy("head").agg(F.collect_list("file").alias("files")).collect()  # a row a file
    out = None
    for r in layouts:
        names = _bulk_columns(r["head"]) if r["head"] else list(_BULK)
        raw = spark.read.option("mode", "PERMISSIVE").schema(", ".join(f"`{n}` string" for n in names)).csv([unquote(f) if f.startswith("file:") else f for f in r["files"]])
        kind = lambda c: "string" if c == "name" else "double"
        wanted = [*_BULK, "vpdmin_hpa", "vpdmax_hpa"]
        value = {c: F.col(c).try_cast(kind(c)) if c in names else F.lit(None).cast(kind(c)) for c in wanted if c != "date"} | {"date": F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")}
        part = raw.select(*[value[c].alias(c) for c in wanted]).where("date is not null")
        out = part if out is None else out.unionByName(part)
    return out


def read_climate_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The older climate files, ``{beach}_raw.csv`` with a header: beach, date and measures under their present names."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*_raw.csv").csv(path)
    beach = F.regexp_extract(F.col("_metadata.file_name"), "^(.*)_raw\\.csv$", 1)
    named = {c: CLIMATE_NAMES.get(c.strip().lower(), c.strip()) for c in raw.columns}
    measures = [F.col(f"`{c}`").try_cast("double").alias(n) for c, n in named.items() if n != "date"]
    return raw.select(beach.alias("beach"), F.to_date(F.col(f"`{next(c for c, n in named.items() if n == 'date')}`")).alias("date"), *measures)


def read_events(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Event CSVs of all beaches with the file they came from."""
    schema = "mid_date date, start_date date, end_date date, volume double, vol_unc double, elevation double, alongshore_centroid_m double, alongshore_start_m double, alongshore_end_m double, width double, height double, month int"
    return spark.read.option("header", True).option("pathGlobFilter", glob).option("enforceSchema", False).schema(schema).csv(path).withColumn("source", F.col("_metadata.file_name"))


def site_of_file(name) -> F.Column:
    """The number in ``D0582_...``."""
    return F.nullif(F.regexp_extract(name, r"D([0-9]{4})_", 1), F.lit("")).try_cast("int")
