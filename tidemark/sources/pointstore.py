"""Points as a grid-sorted Parquet store.

Rows are ordered by the Morton code of their grid cell, so a file and each of
its row groups cover a small area, and their statistics of x and y let a box
query skip the rest.  A manifest names every file's extent and count: a query
opens only the files that its box touches, and within them only such row groups.

    store/points/    the rows, with their code in ``morton``
    store/manifest/  a row a file: path, n, xmin, ymin, xmax, ymax, first, last
    store/layout/    one row: cell, x0, y0
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cell_number, morton

#: Bytes of a row group, rows of a file, and the side of a cell in the points' unit.
ROW_GROUP, FILE_ROWS, CELL = 1 << 20, 4_000_000, 1.0


def _cells(x: Column, y: Column, x0: float, y0: float, cell: float) -> Column:
    return morton(cell_number(x, x0, cell), cell_number(y, y0, cell))


def write_points(points: DataFrame, path: str, cell: float = CELL, file_rows: int = FILE_ROWS, row_group: int = ROW_GROUP) -> None:
    """Write points (x, y and any other columns) as a store; rows without a place go to its end.

    A range of (code, x, y) is a file, so one crowded cell is dealt over several.
    The counts of the manifest must be those of the points, or an error is raised.
    """
    spark = points.sparkSession
    about = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    x0, y0 = about["x0"] or 0.0, about["y0"] or 0.0
    if max((about["x1"] or 0.0) - x0, (about["y1"] or 0.0) - y0) >= cell * (1 << 31):
        raise ValueError("the points span more than 2**31 cells a side")
    rows = points.withColumn("morton", _cells(F.col("x"), F.col("y"), x0, y0, cell))
    dealt = rows.repartitionByRange(max(1, -(-about["n"] // file_rows)), F.asc_nulls_last("morton"), "x", "y").sortWithinPartitions(F.asc_nulls_last("morton"), "x", "y")
    dealt.write.mode("errorifexists").option("parquet.block.size", row_group).option("parquet.page.size", row_group // 16).parquet(f"{path}/points")
    spark.createDataFrame([(float(cell), float(x0), float(y0))], "cell double, x0 double, y0 double").coalesce(1).write.parquet(f"{path}/layout")
    files = spark.read.parquet(f"{path}/points").groupBy(F.col("_metadata.file_path").alias("path"))
    files.agg(
        F.count("*").alias("n"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.min("morton").alias("first"), F.max("morton").alias("last")
    ).coalesce(1).write.parquet(f"{path}/manifest")
    written = manifest(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if written != about["n"]:
        raise RuntimeError(f"the store holds {written} of {about['n']} points")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def files_in(spark: SparkSession, path: str, bounds: tuple[float, float, float, float]) -> list[str]:
    """Files whose extent meets a closed box (xmin, ymin, xmax, ymax)."""
    a, b, c, d = bounds
    near = manifest(spark, path).where((F.col("xmax") >= a) & (F.col("xmin") <= c) & (F.col("ymax") >= b) & (F.col("ymin") <= d))
    return sorted(r["path"] for r in near.select("path").collect())  # a row a file


def read_points(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The points of a store, or those within a closed box, from the files and row groups that meet it.

    Codes lie between those of the box's corners, which prunes row groups beside x and y.
    """
    whole = spark.read.parquet(f"{path}/points")
    if bounds is None:
        return whole.drop("morton")
    files = files_in(spark, path, bounds)
    if not files:
        return whole.where(F.lit(False)).drop("morton")
    a, b, c, d = bounds
    layout = spark.read.parquet(f"{path}/layout").first()
    corner = lambda x, y: _corner(max(0, math.floor((x - layout["x0"]) / layout["cell"])), max(0, math.floor((y - layout["y0"]) / layout["cell"])))
    inside = F.col("x").between(a, c) & F.col("y").between(b, d) & F.col("morton").between(corner(a, b), corner(c, d))
    return spark.read.schema(whole.schema).parquet(*files).where(inside).drop("morton")


def _corner(cx: int, cy: int) -> int:
    """The code of one cell; beyond 31 bits the last cell's."""
    cx, cy = (min(v, (1 << 31) - 1) for v in (cx, cy))
    return sum((cx >> i & 1) << 2 * i | (cy >> i & 1) << 2 * i + 1 for i in range(31))
