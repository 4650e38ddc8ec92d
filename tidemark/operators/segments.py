"""Points along lines by boxes of short segments, as a box index is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

SEGMENT = 20.0


def segment_boxes(lines: DataFrame, buffer: float, segment: float = SEGMENT) -> DataFrame:
    """tr_id, long, segment, xmin, ymin, xmax, ymax: boxes around the segments of each line (tr_id, x0, y0, x1, y1).

    A line of up to two segments has one box; a longer one is cut into equal
    parts of at most ``segment``.
    """
    size = g.length("x0", "y0", "x1", "y1")
    long = size > 2 * segment
    n = F.when(long, F.greatest(F.ceil(size / segment), F.lit(2))).otherwise(F.lit(1)).cast("int")
    parts = lines.select("tr_id", "x0", "y0", "x1", "y1", long.alias("long"), n.alias("_n")).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    k = F.col("segment")
    xs, ys = (at("x0", "x1", k), at("x0", "x1", k + 1)), (at("y0", "y1", k), at("y0", "y1", k + 1))
    return parts.select(
        "tr_id", "long", "segment", (F.least(*xs) - buffer).alias("xmin"), (F.least(*ys) - buffer).alias("ymin"), (F.greatest(*xs) + buffer).alias("xmax"), (F.greatest(*ys) + buffer).alias("ymax"),
    )


def in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) with every closed box that holds them: boxes are named in the cells they touch, a point lies in one."""
    number = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("long")
    named = boxes.withColumn("_cx", F.explode(F.sequence(number("xmin"), number("xmax")))).withColumn("_cy", F.explode(F.sequence(number("ymin"), number("ymax"))))
    keyed = points.withColumn("_px", number("x")).withColumn("_py", number("y"))
    on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return keyed.join(named, on).drop("_cx", "_cy", "_px", "_py", "xmin", "ymin", "xmax", "ymax")


def points_by_segments(points: DataFrame, lines: DataFrame, buffer: float, order: list[str | Column], segment: float = SEGMENT, digits: int = 3) -> DataFrame:
    """tr_id and the points within the segment boxes of each line, ``buffer`` and one unit wide.

    Where a line has several boxes, of points at one place to ``digits`` decimals
    the first is kept, by segment, ``order`` and place; a single box keeps them all.
    Intensities are divided by the greatest of a line's kept points, or left
    where that is 0.
    """
    boxes = segment_boxes(lines, buffer + 1, segment)
    hit = in_boxes(points, boxes, segment + 2 * (buffer + 1))
    place = [F.round(F.col(c) * 10.0**digits).alias(f"_{c}") for c in "xyz"]  # of the product as it is, so a tie of decimals goes where the double lies
    # what tells points of a single box apart: all they have, in their own order
    own = F.when(~F.col("long"), F.struct(*order))
    row = F.struct(*points.columns)
    kept = hit.groupBy("tr_id", *place, own.alias("_own")).agg(F.min_by(row, F.struct("segment", *order, "x", "y", "z")).alias("_p"), F.when(F.first("long"), 1).otherwise(F.count("*")).alias("_n"))
    rows = kept.select("tr_id", "_p.*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_copy")
    if "intensity" not in points.columns:
        return rows
    top = rows.groupBy("tr_id").agg(F.max("intensity").alias("_top"))
    joined = rows.join(top, "tr_id")
    return joined.withColumn("intensity", F.col("intensity") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)).drop("_top")
