"""Integer vectors in tiles, the layout that the operators on vectors share.

A tile packs up to ``TILE`` vectors of one length into a row: their ids, an
optional group each, and the components as one array of the narrowest integer
type that holds them.  Tiles are written to the shared folder once, so a row is
known by (tile, place) wherever it goes, also where ids repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TILE = 2048

TILE_COLUMNS = "width int, tile long, n int, ids array<long>, groups array<long>, body binary"


def finite(x: Column) -> Column:
    """True where an array of doubles holds neither nulls nor NaN nor infinities."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def integer_vectors(vectors: DataFrame, scale: float, group: Column | None = None, vector: str = "embedding") -> DataFrame:
    """vec_id, grp and v, floor(scale * x) of every component, of the vectors that are whole and finite."""
    x = F.col(vector).cast("array<double>")
    group = F.lit(None) if group is None else group
    rows = vectors.where(x.isNotNull()).where(F.coalesce(finite(x), F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), group.cast("long").alias("grp"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("v"))


def narrowest(v: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    for kind in ("<i1", "<i2", "<i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return v.astype(kind)
    return v.astype("<i8")


def body_of(v: np.ndarray) -> bytes:
    """Components as bytes; the first names the integer type's size."""
    v = narrowest(v)
    return bytes([v.itemsize]) + v.tobytes()


def open_body(body: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(body, f"<i{body[0]}", offset=1).reshape(n, width)



def tile_rows(batches, columns, more):
    """Arrow batches of (vec_id, grp, v) to batches of tiles; ``more(ids, groups, v)`` gives further columns of a tile."""
    held: dict[int, list] = {}
    seen, part = 0, TaskContext.get().partitionId()

    def tile(width: int) -> pa.RecordBatch:
        nonlocal seen
        ids, groups, body = held.pop(width)
        v = np.concatenate(body)
        order = sorted(range(len(ids)), key=lambda i: (groups[i] is None, groups[i] or 0))
        ids, groups, v = [ids[i] for i in order], [groups[i] for i in order], v[order]
        row = {"width": width, "tile": (part << 32) + seen, "n": len(ids), "ids": ids, "groups": groups, "body": body_of(v)} | more(ids, groups, v)
        seen += 1
        return pa.RecordBatch.from_pylist([row], schema=columns)

    for b in batches:
        lists = b.column("v")
        widths = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ids, groups = b.column("vec_id").to_pylist(), b.column("grp").to_pylist()
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            for at in range(0, len(rows), TILE):
                own = rows[at : at + TILE]
                v = flat[starts[own][:, None] + np.arange(width)]
                h = held.setdefault(width, [[], [], []])
                h[0] += [ids[i] for i in own]
                h[1] += [groups[i] for i in own]
                h[2].append(v.astype(np.int64))
                if len(h[0]) >= TILE:
                    yield tile(width)
    for width in sorted(held):
        yield tile(width)


def tiles_of(rows: DataFrame, name: str, more=None, more_columns: str = "") -> DataFrame:
    """The vectors of ``integer_vectors`` as a written table of tiles, ordered by group within a tile."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = TILE_COLUMNS + (", " + more_columns if more_columns else "")
    columns = to_arrow_schema(StructType.fromDDL(spec))
    more = more or (lambda ids, groups, v: {})
    return materialize(rows.select("vec_id", "grp", "v").mapInArrow(lambda b: tile_rows(b, columns, more), spec), name)


ASKED_COLUMNS = "width int, q_tile long, q_place int, q_id long, q_group long, q_body binary"


def members(tiles: DataFrame, wanted) -> DataFrame:
    """Single vectors of the tiles, those whose id passes ``wanted`` (an array of ids to an array of truth)."""

    def chosen(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.array([-1 if i is None else i for i in r["ids"]], np.int64)
                known = np.array([i is not None for i in r["ids"]], bool)
                v = open_body(r["body"], r["n"], r["width"])
                own = np.flatnonzero(known & wanted(ids))
                for at in range(0, len(own), 512):
                    rows = [
                        {"width": r["width"], "q_tile": r["tile"], "q_place": int(i), "q_id": int(ids[i]), "q_group": r["groups"][i], "q_body": body_of(v[i])}
                        for i in own[at : at + 512]
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=_asked_schema())

    return tiles.select("width", "tile", "n", "ids", "groups", "body").mapInArrow(chosen, ASKED_COLUMNS)


def _asked_schema() -> pa.Schema:
    return pa.schema([("width", pa.int32()), ("q_tile", pa.int64()), ("q_place", pa.int32()), ("q_id", pa.int64()), ("q_group", pa.int64()), ("q_body", pa.binary())])


def check_products(q: np.ndarray, c: np.ndarray) -> None:
    """Inner products must fit in a long: none is returned wrong."""
    if float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1]) >= 2.0**62:
        raise OverflowError("an inner product of these components can't be held in 64 bits")


def first_by_score(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


#: Queries of a block, tiles that a task scans for a block at least where there are many.
BLOCK, SCAN = 512, 16


def blocks_and_tiles(asked: DataFrame, tiles: DataFrame, n_asked: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (width, block, part): every block of queries against every part of the tiles.

    A block holds about BLOCK queries by the hash of their place, a part about SCAN
    tiles, so no key grows with the table and no hot id or group makes one large.
    """
    spark = asked.sparkSession
    n_blocks, n_tiles = max(1, -(-n_asked // BLOCK)), max(1, tiles.count())
    n_parts = max(-(-n_tiles // SCAN), min(n_tiles, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("q_tile", "q_place"), F.lit(n_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = tiles.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(n_parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left, right
