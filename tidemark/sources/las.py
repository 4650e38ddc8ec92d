"""LAS point clouds as a Python data source.

A file is cut into byte ranges of whole points, one partition each, so a large
file is read by several tasks and never held whole; planning needs its size
alone.  A task reads the header (375 bytes), leaves a file whose extent misses
the box, and parses the places of its points before anything else, so what lies
outside the box costs 8 bytes a point.

    spark.read.format("las").option("bounds", "0,0,10,10").load("/data/surveys")

Files are opened through Arrow's file systems (local and mounted paths, hdfs,
s3, gs).  With the option ``pushdown`` (which needs the setting
``spark.sql.python.filterPushdown.enabled``) the box is also taken from the
query's conditions on x and y.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "las_source string, point long, x double, y double, z double, intensity float, red float, green float, blue float, classification float, return_number float, num_returns float"
#: Bytes of a header, of a partition, and points parsed at a time.
HEADER, SPLIT, CHUNK = 375, 64 << 20, 250_000
#: Where the colours of each point format stand.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
ALL = (-np.inf, -np.inf, np.inf, np.inf)


def header(content: bytes) -> dict:
    """Version, point format and size, counts, scales, offsets, bounds and where the records stand."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    size_of_header, start, n_records, form, size, count = struct.unpack_from("<HIIBHI", content, 94)
    scale, offset = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", content, 179)
    if content[25] >= 4 and len(content) >= 255:
        count = struct.unpack_from("<Q", content, 247)[0] or count
    return {
        "version": f"{content[24]}.{content[25]}", "format": form & 0x3F, "compressed": form >= 0x80, "size": size, "start": start, "count": count, "scale": scale, "offset": offset,
        "bounds": (xmin, ymin, zmin, xmax, ymax, zmax), "records_at": size_of_header, "n_records": n_records,
    }


def records(file, h: dict) -> Iterator[tuple[str, int, int]]:
    """(user id, record id, bytes) of each variable-length record; their bodies are skipped."""
    at = h["records_at"]
    for _ in range(h["n_records"]):
        file.seek(at)
        head = file.read(54)
        if len(head) < 54 or at + 54 > h["start"]:
            return
        user, number, n = struct.unpack_from("<2x16sHH", head)
        yield user.split(b"\0")[0].decode("latin-1"), number, n
        at += 54 + n


def opened(path: str):
    """An Arrow file to read from, at a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listing(path: str, pattern: str = "*.las") -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of one file, in order."""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    else:
        system, inner, prefix = fs.LocalFileSystem(), path, ""
    about = system.get_file_info(inner)
    found = system.get_file_info(fs.FileSelector(inner)) if about.type == fs.FileType.Directory else [about]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), pattern))


def _overlaps(h: dict, box: tuple) -> bool:
    xmin, ymin, _, xmax, ymax, _ = h["bounds"]
    return not h["count"] or (xmax >= box[0] and xmin <= box[2] and ymax >= box[1] and ymin <= box[3])


def points(name: str, file, lo: int, hi: int, h: dict, box: tuple = ALL) -> Iterator[pa.RecordBatch]:
    """The points ``lo`` to ``hi`` of a file within a closed box."""
    modern, colour = h["format"] >= 6, COLOUR_AT.get(h["format"])
    for first in range(lo, hi, CHUNK):
        n = min(CHUNK, hi - first)
        file.seek(h["start"] + first * h["size"])
        raw = np.frombuffer(file.read(n * h["size"]), np.uint8)
        raw = raw[: len(raw) // h["size"] * h["size"]].reshape(-1, h["size"])
        at = lambda rows, i, kind: np.ascontiguousarray(rows[:, i : i + np.dtype(kind).itemsize]).view(kind).ravel()
        place = lambda rows, k: at(rows, 4 * k, "<i4") * h["scale"][k] + h["offset"][k]
        x, y = place(raw, 0), place(raw, 1)
        inside = np.flatnonzero((x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3]))
        if not len(inside):
            continue
        rows = raw[inside]
        bits = rows[:, 14]
        rgb = [(at(rows, colour + 2 * k, "<u2") / 65535 if colour else np.zeros(len(rows))).astype("f4") for k in range(3)]
        columns = [
            pa.array([name] * len(rows)), pa.array(first + inside, pa.int64()), pa.array(x[inside]), pa.array(y[inside]), pa.array(place(rows, 2)), pa.array(at(rows, 12, "<u2").astype("f4")), *map(pa.array, rgb),
            pa.array((rows[:, 16] if modern else rows[:, 15] & 31).astype("f4")), pa.array((bits & (15 if modern else 7)).astype("f4")), pa.array(((bits >> 4) if modern else (bits >> 3) & 7).astype("f4")),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class LasRange(InputPartition):
    """One of ``parts`` equal ranges of a file's points."""

    path: str
    part: int
    parts: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        given = options.get("bounds")
        self.box = tuple(float(v) for v in given.split(",")) if given else ALL

    def partitions(self):
        out = []
        for path, size in listing(self.path):
            n = max(1, -(-size // self.split))
            out += [LasRange(path, i, n) for i in range(n)]
        return out or [LasRange("", 0, 0)]

    def read(self, partition: LasRange):
        if not partition.parts:
            return
        name = partition.path.rsplit("/", 1)[-1]
        with opened(partition.path) as file:
            h = header(file.read(HEADER))
            if not _overlaps(h, self.box):
                return
            if h["compressed"]:
                raise ValueError(f"{name}: compressed points need an optional decoder")
            lo, hi = (h["count"] * k // partition.parts for k in (partition.part, partition.part + 1))
            yield from points(name, file, lo, hi, h, self.box)


class PushingLasReader(LasReader):
    """Also takes the box from the query's own conditions."""

    def pushFilters(self, filters):
        """Takes the box from conditions on x and y; Spark applies every condition again."""
        low, high = list(self.box[:2]), list(self.box[2:])
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",)):
                k = "xy".index(f.attribute[0])
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low[k] = max(low[k], float(f.value))
                else:
                    high[k] = min(high[k], float(f.value))
            yield f
        self.box = (*low, *high)


class LasSource(DataSource):
    """``spark.read.format("las")``: options path, bounds (xmin,ymin,xmax,ymax), split (bytes of a partition) and pushdown."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return (PushingLasReader if self.options.get("pushdown", "").lower() == "true" else LasReader)(self.options)
