"""Queries over points: the grid-sorted store, segmented line queries and the sampled corridor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, segments
from ..sources import pointstore
from ..sources.scratch import shared_path
from . import carriers as k
from .survey_queries import POINTS_BBOX, _lines, _round


def points_bbox_sorted(spark, d):
    """``points_bbox`` over a grid-sorted copy of all points."""
    path = shared_path(spark, "points")
    pointstore.write_points(k.points(spark, d), path)
    box = pointstore.read_points(spark, path, (20.0, 10.0, 60.0, 30.0))
    return box.groupBy("las_source").agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def _corridor(rows):
    return _round(rows.groupBy("tr_id").agg(F.count("*").alias("n"), F.avg("along").alias("along"), F.max("across").alias("across"), F.sum("intensity").alias("intensity")), "along", "across", "intensity")


def points_segmented(spark, d):
    """Points of every line by its 20 m segments, without repeats, then the corridor's."""
    p = k.points(spark, d).select("x", "y", "z", F.col("intensity").cast("double").alias("intensity"), "classification", "las_source")
    near = segments.points_by_segments(p, _lines(spark), 1.5, ["las_source", "intensity", "classification"])
    return _corridor(joins.corridor_of(near.join(F.broadcast(_lines(spark)), "tr_id"), 1.5))  # ten lines


_LINES = """l as (select i::integer as tr_id, 0.0::double as x0, 5.0::double + 4 * i as y0, 100.0::double as x1, 8.0::double + 4 * i as y1 from range(0, 10) t(i)),
u as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as len from l), w as (select *, (x1 - x0) / (len + 1e-8) as dx, (y1 - y0) / (len + 1e-8) as dy from u)"""
POINTS_SEGMENTED = f"""with {k.POINTS}, {_LINES}, s as (select w.*, j, ceil(len / 20) as n from w, range(0, 6) t(j)),
b as (select *, least(x0 + (x1 - x0) * j / n, x0 + (x1 - x0) * (j + 1) / n) - 2.5 as xa, greatest(x0 + (x1 - x0) * j / n, x0 + (x1 - x0) * (j + 1) / n) + 2.5 as xb,
  least(y0 + (y1 - y0) * j / n, y0 + (y1 - y0) * (j + 1) / n) - 2.5 as ya, greatest(y0 + (y1 - y0) * j / n, y0 + (y1 - y0) * (j + 1) / n) + 2.5 as yb from s where j < n),
h as (select b.tr_id, p.x, p.y, p.z, p.intensity::double as intensity, row_number() over (partition by b.tr_id, round(p.x, 3), round(p.y, 3), round(p.z, 3) order by b.j, las_source, intensity, classification) as r from points p join b on p.x between xa and xb and p.y between ya and yb),
f as (select *, max(intensity) over (partition by tr_id) as top from h where r = 1),
c as (select f.tr_id, len, (x - x0) * dx + (y - y0) * dy as along, abs((x - x0) * dy - (y - y0) * dx) as across, intensity / case when top > 0 then top else 1 end as v from f join w on f.tr_id = w.tr_id)
select tr_id, count(*) as n, round(avg(along), 6) as along, round(max(across), 6) as across, round(sum(v), 6) as intensity from c where along between 0 and len and across <= 1.5 group by 1"""


def points_corridor_sampled(spark, d):
    """Points within 6 m of one of the samples of a line (at least ten, half a buffer apart) and within its corridor."""
    near = joins.corridor_join(k.points(spark, d), F.broadcast(_lines(spark)), 6.0, 8.0, mode="sampled")  # ten lines
    return _round(near.groupBy("tr_id").agg(F.count("*").alias("n"), F.avg("along").alias("along"), F.max("across").alias("across")), "along", "across")


POINTS_SAMPLED = f"""with {k.POINTS}, {_LINES}, m as (select *, greatest(floor(len / 3), 10) as n_samples from w),
s as (select m.*, j, x0 + (x1 - x0) * j / (n_samples - 1) as sx, y0 + (y1 - y0) * j / (n_samples - 1) as sy from m, range(0, 100) t(j) where j < n_samples),
c as (select m.tr_id, m.len, (x - x0) * dx + (y - y0) * dy as along, abs((x - x0) * dy - (y - y0) * dx) as across, x, y from points, m),
k as (select * from c where along between 0 and len and across <= 6)
select k.tr_id, count(*) as n, round(avg(along), 6) as along, round(max(across), 6) as across from k where exists (select 1 from s where s.tr_id = k.tr_id and (x - sx) ** 2 + (y - sy) ** 2 <= 36) group by 1"""

QUERIES = {
    "points_bbox_sorted": (points_bbox_sorted, POINTS_BBOX), "points_segmented": (points_segmented, POINTS_SEGMENTED), "points_corridor_sampled": (points_corridor_sampled, POINTS_SAMPLED),
}
