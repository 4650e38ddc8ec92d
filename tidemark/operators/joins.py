"""Range, as-of, interval and nearest joins over built-in joins.

Spark plans a bare range condition as a nested loop.  Each helper here gives the
planner an equality (a grid cell, a key) and keeps the exact predicate beside
it, so the work is a hash or sort-merge join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def band_join(points: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of ``points`` with every range that holds ``value`` (both ends inclusive).

    A range is named once in each cell of the given width that it touches, a
    value lies in one cell: no pair comes twice.  Column names must differ.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    cells = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    keyed = points.withColumn("_pcell", cell(F.col(value)))
    on = (F.col("_pcell") == F.col("_cell")) & (F.col(value) >= F.col(lo)) & (F.col(value) <= F.col(hi))
    return keyed.join(cells, on, how).drop("_cell", "_pcell")


def first_match(points: DataFrame, ranges: DataFrame, key: list[str], value: str, lo: str, hi: str, order: str, take: list[str], width: float, default: dict | None = None) -> DataFrame:
    """Each row of ``points`` with the first range (by ``order``) that holds its value; without one, nulls or ``default``.

    ``key`` identifies a row.  The choice is an aggregation, so nothing is ranked.
    """
    hit = band_join(points.select(*key, value), ranges.select(lo, hi, order, *take), value, lo, hi, width)
    best = hit.groupBy(*key).agg(F.min_by(F.struct(*take), F.col(order)).alias("_best"))
    out = points.join(best, key, "left")
    filled = [F.coalesce(F.col(f"_best.{c}"), F.lit((default or {}).get(c))).alias(c) for c in take]
    return out.select(*points.columns, *filled)


def nearest_range(points: DataFrame, ranges: DataFrame, key: list[str], value: str, lo: str, hi: str, order: str, take: list[str]) -> DataFrame:
    """As ``first_match``, but a value in no range takes the nearest one (the first of equals).

    ``ranges`` is a dimension: its rows are packed into one array row that is
    broadcast, after a check that it holds no more than 10,000 rows.
    """
    if ranges.limit(10_001).count() > 10_000:
        raise ValueError("nearest_range needs a dimension of at most 10,000 ranges")
    packed = ranges.agg(F.array_sort(F.collect_list(F.struct(order, lo, hi, *take))).alias("_ranges"))
    v = F.col(value)
    off = lambda r: F.when(v < r[lo], r[lo] - v).when(v > r[hi], v - r[hi]).otherwise(F.lit(0)).cast("double")
    best = F.array_min(F.transform("_ranges", lambda r: F.struct(off(r).alias("off"), r[order].alias("ord"), F.struct(*[r[c].alias(c) for c in take]).alias("row"))))
    return points.join(F.broadcast(packed)).withColumn("_best", best).select(*points.columns, *[F.col(f"_best.row.{c}").alias(c) for c in take])


#: Width of a time bucket of ``asof_join``: days for dates, seconds for timestamps.
DAYS, SECONDS = 30, 86_400


def time_bucket(column: str, kind: T.DataType, width: float | None) -> Column:
    """The number of a value's bucket; numbers without a width share one."""
    c = F.col(column)
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(c) / F.lit(width or DAYS)).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(c.cast("timestamp").cast("double") / F.lit(width or SECONDS)).cast("long")
    if width is None:
        return F.when(c.isNotNull(), F.lit(0)).cast("long")
    return F.floor(c / F.lit(width)).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], direction: str = "backward", strict: bool = False, width: float | None = None
) -> DataFrame:
    """Each left row with the last right row at or before it (``backward``) or the first at or after it (``forward``).

    Both sides are stacked, dealt by key and time bucket, and the latest right
    row is carried along in a bucket; what a bucket starts with is carried over
    from the border rows of the buckets before it, a row a bucket.  So a key's
    history, or that of all rows where ``by`` is empty, is shared by many tasks.
    ``strict`` leaves equal times out.  Of right rows at one time the greatest
    (going forward the least) by their columns is taken; null keys and times
    match nothing.
    """
    if not by and width is None and not isinstance(left.schema[left_on].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("name a key or give the width of a bucket: without either all rows would meet in one task")
    back = direction == "backward"
    at = lambda df, c: (F.col(c).alias("_t"), time_bucket(c, df.schema[c].dataType, width).alias("_b"))
    # In the direction of the scan a right row comes before a left row of its time, unless equal times are left out.
    known = right.where(" and ".join(f"`{c}` is not null" for c in [*by, right_on]))
    r = known.select(*by, *at(right, right_on), F.lit(1 if strict else 0).alias("_side"), F.struct(F.col(right_on), *[c for c in take if c != right_on]).alias("_r"))
    l = left.select(*by, *at(left, left_on), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)))
    way = F.asc if back else F.desc
    w = Window.partitionBy(*by, "_b").orderBy(way("_t"), "_side", way("_r"))
    own = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_hit", own).where("_l is not null")
    edge = F.struct("_t", "_r")
    edges = both.groupBy(*by, "_b").agg((F.max if back else F.min)(F.when(F.col("_r").isNotNull(), edge)).alias("_e"))
    over = Window.partitionBy(*by).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carried = edges.select(*by, "_b", F.last("_e", True).over(over).getField("_r").alias("_c")).where("_c is not null")
    found = found.join(carried, [*by, "_b"], "left").withColumn("_hit", F.coalesce("_hit", "_c"))
    return found.select("_l.*", *[F.col(f"_hit.{c}").alias(c) for c in take])


def bracket(events: DataFrame, epochs: DataFrame, start: str, end: str, epoch_date: str, epoch: str) -> DataFrame:
    """Events with the last epoch at or before their start and the first at or after their end; those without both go.

    Two as-of joins; of epochs of one date the greatest is before, the least after.
    """
    e = epochs.select(F.col(epoch_date).alias("_date"), F.col(epoch).alias("epoch_before"))
    found = asof_join(events, e, [], start, "_date", ["epoch_before"])
    found = asof_join(found, e.withColumnRenamed("epoch_before", "epoch_after"), [], end, "_date", ["epoch_after"], direction="forward")
    return found.where("epoch_before < epoch_after")


def interval_overlap(left: DataFrame, right: DataFrame, left_lo: str, left_hi: str, right_lo: str, right_hi: str, width: float, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of closed intervals that overlap, with equal values in each pair of columns of ``by`` (left, right).

    Both sides are named in each cell they touch; a pair is kept in the first
    cell that both touch, so it comes once.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    a = left.withColumn("_a", F.explode(F.sequence(cell(left_lo), cell(left_hi))))
    b = right.withColumn("_b", F.explode(F.sequence(cell(right_lo), cell(right_hi))))
    first = F.greatest(cell(left_lo), cell(right_lo))
    on = (F.col("_a") == F.col("_b")) & (F.col("_a") == first) & (F.col(left_lo) <= F.col(right_hi)) & (F.col(right_lo) <= F.col(left_hi))
    for x, y in by:
        on = on & (F.col(x) == F.col(y))
    return a.join(b, on).drop("_a", "_b")


def overlapping_pairs(rows: DataFrame, key: str, lo: str, hi: str, width: float, by: list[str] = ()) -> DataFrame:
    """a, b, *by: keys (a < b) of any two closed intervals of one group that overlap, each two rows once.

    Of two such intervals the later one (by start, then key) starts inside the
    other.  So a row is named once as the later one, in the list of the cell it
    starts in, and in each cell it touches as the earlier one; it meets the whole
    list of a cell that it spans.  Equal lists one after the other in order of keys
    take little space in files.  A list is far shorter than the pairs it is part
    of; any width gives the same pairs.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    sound = rows.where(F.col(lo) <= F.col(hi))
    first = sound.select(*by, F.col(key).alias("_x"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.explode(F.sequence(cell(lo), cell(hi))).alias("_c"))
    lists = sound.groupBy(*by, cell(lo).alias("_c")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_y"), F.col(lo).alias("_at")))).alias("_ys"))
    x, y, start, end, c = (F.col(n) for n in ("_x", "_y", "_lo", "_hi", "_c"))
    spanned = (start < c * F.lit(width)) & (end >= (c + 1) * F.lit(width))
    inside = F.filter("_ys", lambda p: (p["_at"] <= end) & ((p["_at"] > start) | ((p["_at"] == start) & (p["_y"] > x))))
    met = first.join(lists.hint("merge"), [*by, "_c"]).select(*by, x, F.inline(F.when(spanned, F.col("_ys")).otherwise(inside))).where(x != y)
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), *by)


def rectangle_overlap(left: DataFrame, right: DataFrame, dims: list[tuple[str, str, str, str, float]], by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs whose closed intervals overlap in every dimension (left_lo, left_hi, right_lo, right_hi, cell width).

    Both sides are named in each cell of the grid that they touch, and a pair is
    kept in the first cell that both touch in every dimension, so it comes once.
    Columns may be numbers or dates (a date's width is in days).
    """
    a, b, on = left, right, F.lit(True)
    for n, (llo, lhi, rlo, rhi, width) in enumerate(dims):
        number = lambda df, c: F.unix_date(F.col(c)) if isinstance(df.schema[c].dataType, T.DateType) else F.col(c)
        cell = lambda df, c, w=width: F.floor(number(df, c) / F.lit(w)).cast("long")  # noqa: E731, B023
        a = a.where(F.col(llo) <= F.col(lhi)).withColumn(f"_a{n}", F.explode(F.sequence(cell(left, llo), cell(left, lhi))))
        b = b.where(F.col(rlo) <= F.col(rhi)).withColumn(f"_b{n}", F.explode(F.sequence(cell(right, rlo), cell(right, rhi))))
        first = F.greatest(cell(left, llo), cell(right, rlo))
        on = on & (F.col(f"_a{n}") == F.col(f"_b{n}")) & (F.col(f"_a{n}") == first) & (F.col(llo) <= F.col(rhi)) & (F.col(rlo) <= F.col(lhi))
    for x, y in by:
        on = on & (F.col(x) == F.col(y))
    return a.join(b, on).drop(*[f"_{s}{n}" for s in "ab" for n in range(len(dims))])


def nearest_within(left: DataFrame, right: DataFrame, key: list[str], value: str, target: str, take: list[str], tolerance: float) -> DataFrame:
    """Each left row with the right row whose target is nearest (the lowest ``take`` of equals), if within the tolerance."""
    near = right.select(F.col(target).alias("_target"), (F.col(target) - tolerance).alias("_lo"), (F.col(target) + tolerance).alias("_hi"), *take)
    hit = band_join(left.select(*key, value), near, value, "_lo", "_hi", max(2 * tolerance, 1e-9))
    best = hit.groupBy(*key).agg(F.min_by(F.struct(*take), F.struct(F.abs(F.col(value) - F.col("_target")), *take)).alias("_best"))
    return left.join(best, key, "left").select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in take])


def corridor_join(points: DataFrame, lines: DataFrame, buffer: float, cell: float, mode: str = "corridor") -> DataFrame:
    """Points (x, y) within ``buffer`` of a line (tr_id, x0, y0, x1, y1), with along- and across-track distances.

    A line is named in the grid cells around samples of it, a point lies in one
    cell.  ``mode="sampled"`` keeps only points within the buffer of one of the
    samples half a buffer apart (at least ten), the rule of a radius search.
    """
    from ..functions import geometry as g

    n = F.greatest(F.ceil(g.length("x0", "y0", "x1", "y1") / F.lit(cell / 2)).cast("int"), F.lit(1))
    step = F.sequence(F.lit(0), n)
    spots = F.flatten(
        F.transform(
            step,
            lambda k: F.flatten(
                F.transform(
                    F.sequence(F.lit(-1), F.lit(1)),
                    lambda i: F.transform(
                        F.sequence(F.lit(-1), F.lit(1)),
                        lambda j: F.struct(
                            (F.floor((F.col("x0") + (F.col("x1") - F.col("x0")) * k / n) / cell) + i).cast("long").alias("cx"),
                            (F.floor((F.col("y0") + (F.col("y1") - F.col("y0")) * k / n) / cell) + j).cast("long").alias("cy"),
                        ),
                    ),
                )
            ),
        )
    )
    if cell < buffer:
        raise ValueError("a cell must be at least as wide as the buffer")
    cells = _measured(lines).withColumn("_cell", F.explode(F.array_distinct(spots)))
    keyed = points.withColumn("_pcell", F.struct(F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy")))
    near = keyed.join(cells, F.col("_pcell") == F.col("_cell")).drop("_cell", "_pcell")
    return corridor_of(near, buffer, mode)


def _measured(lines: DataFrame) -> DataFrame:
    """Lines with their length and direction, worked out once a line where this comes before the join."""
    from ..functions import geometry as g

    dx, dy = g.direction("x0", "y0", "x1", "y1")
    return lines.withColumns({"_size": g.length("x0", "y0", "x1", "y1"), "_dx": dx, "_dy": dy})


def corridor_of(pairs: DataFrame, buffer: float, mode: str = "corridor") -> DataFrame:
    """Of points paired with lines those in the line's corridor, with along- and across-track distances."""
    from ..functions import geometry as g

    near = pairs if "_size" in pairs.columns else _measured(pairs)
    dx, dy, size = map(F.col, ("_dx", "_dy", "_size"))
    near = near.withColumn("along", g.along(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), dx, dy))
    near = near.withColumn("across", g.across(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), dx, dy))
    kept = near.where((F.col("along") >= 0) & (F.col("along") <= size) & (F.col("across") <= buffer))
    if mode == "sampled":
        # by the nearest sample's own place: along and across are short of true distances by the direction's epsilon
        last = F.greatest(F.floor(size / (buffer / 2)), F.lit(10)) - 1
        at = F.least(F.greatest(F.rint(F.coalesce(F.try_divide(F.col("along"), size / last), F.lit(0.0))), F.lit(0.0)), last)
        ox, oy = (F.col(c) - (F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * at / last) for c in "xy")
        kept = kept.where(F.pow(ox, F.lit(2.0)) + F.pow(oy, F.lit(2.0)) <= buffer * buffer)
    return kept.drop("_size", "_dx", "_dy")


def keep_last(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def keep_first(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Of rows with one key the first by ``order``."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")
