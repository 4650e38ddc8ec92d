"""Comparisons, coverage, validation and losses, as a viewer or a training run asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import joins


def beach_coverage(cells: DataFrame, slices: DataFrame, epochs: DataFrame) -> DataFrame:
    """beach, present, total, pct of each slice [first, end) of transects over all epochs; slices without cells stay."""
    n = epochs.agg(F.count_distinct("epoch_idx").alias("_n"))  # one row
    held = joins.band_join(cells.select("transect_idx", "epoch_idx").distinct(), slices.withColumn("_last", F.col("end") - 1).select("beach", "first", "_last"), "transect_idx", "first", "_last", 64)
    present = held.groupBy("beach").agg(F.count("*").alias("present"))
    out = slices.join(present, "beach", "left").join(F.broadcast(n)).withColumn("present", F.coalesce("present", F.lit(0)))
    total = ((F.col("end") - F.col("first")) * F.col("_n")).cast("long")
    return out.select("beach", "present", total.alias("total"), F.when(total > 0, 100.0 * F.col("present") / total).otherwise(0.0).alias("pct"))


def validation(cells: DataFrame, n_cells: Column, points: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: missing cells, coverage, NaN counts and range issues; not valid only where a feature has NaN or null."""
    c = cells.agg((n_cells - F.count("*")).alias("missing"), (100.0 * F.count("*") / n_cells).alias("coverage_pct"))
    bad = lambda f: F.col(f).isNull() | F.isnan(f)
    p = points.agg(
        *[F.count_if(bad(f)).alias(f"_nan_{f}") for f in ranges], *[F.coalesce(F.bool_or(~bad(f) & ~F.col(f).between(lo, hi)), F.lit(False)).cast("int").alias(f"_off_{f}") for f, (lo, hi) in ranges.items()]
    )
    total = lambda head: sum((F.col(f"_{head}_{f}") for f in ranges), F.lit(0))
    out = c.join(F.broadcast(p))  # one row each
    return out.select(
        F.col("missing").cast("long").alias("missing"), "coverage_pct", total("nan").cast("long").alias("n_nan"), total("off").cast("long").alias("n_range_issues"),
        ((F.col("missing") > 0).cast("int") + (total("nan") > 0).cast("int") + (total("off") > 0).cast("int")).alias("n_warnings"), (total("nan") == 0).alias("is_valid"),
    )


def compared(points: DataFrame, by: list[str], id: str, value: str, most: int = 10) -> DataFrame:
    """by, id, n, min, max, mean, std of a feature for the ``most`` ids of each group with the widest range."""
    each = points.groupBy(*by, id).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("max") - F.col("min")), id)
    return each.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def storm_hours_by_month(waves: DataFrame, by: list[str], ts: str = "ts", hs: str = "hs", share: float = 0.95) -> DataFrame:
    """by, month, hours: rows above their group's own percentile; months with rows but none above count 0."""
    limit = waves.groupBy(*by).agg(F.percentile(hs, share).alias("_limit"))
    return waves.join(limit, by).groupBy(*by, F.month(ts).alias("month")).agg(F.count_if(F.col(hs) > F.col("_limit")).alias("hours"))


def annual_totals(daily: DataFrame, by: list[str], date: str, value: str, extreme: float) -> DataFrame:
    """by, year, total and days at or above ``extreme``."""
    return daily.groupBy(*by, F.year(date).alias("year")).agg(F.sum(value).alias("total"), F.count_if(F.col(value) >= extreme).alias("extreme_days"))


def queue_progress(queue: DataFrame, labels: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """One row: events in the queue, those with a label, and the position of the first without one (null where all have)."""
    x = queue.join(labels.select(*key, label), key, "left")
    seen = F.coalesce(F.col(label) >= 0, F.lit(False))
    return x.agg(F.count("*").alias("total"), F.count_if(seen).alias("labeled"), F.min(F.when(~seen, F.col("position"))).alias("next_position"))


def losses(rows: DataFrame, weights: list[float] | None = None, weight_risk: float = 1.0, weight_class: float = 1.0, classes: int = 4) -> DataFrame:
    """One row: loss_risk, loss_event_class and loss of predictions against targets.

    Rows have risk, risk_pred, confidence, event_class and logits.  The risk's is
    the mean of the smooth absolute difference times the confidence, the class's
    the cross-entropy of the first ``classes`` logits, by class weights if given.
    """
    off = F.abs(F.col("risk_pred") - F.col("risk"))
    smooth = F.when(off < 1, 0.5 * off * off).otherwise(off - 0.5)
    first = F.slice("logits", 1, classes)
    top = F.array_max(first)
    spread = top + F.log(F.aggregate(first, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    cross = spread - F.get(first, F.col("event_class"))
    w = F.get(F.array(*map(F.lit, weights or [1.0] * classes)), F.col("event_class"))
    out = rows.agg(F.avg(smooth * F.coalesce("confidence", F.lit(1.0))).alias("loss_risk"), (F.sum(w * cross) / F.sum(w)).alias("loss_event_class"))
    return out.withColumn("loss", weight_risk * F.col("loss_risk") + weight_class * F.col("loss_event_class"))


def voxel_corridor(points: DataFrame, origins: DataFrame, length: float, width: float, bin_size: float, least: int = 1) -> DataFrame:
    """Points within half the width of a line through each origin (tr_id, ox, oy and unit normal nx, ny), ``length`` both ways, with ``distance`` from it.

    As a radius search at samples a bin apart sees them; lines with fewer than
    ``least`` points have none.  The line's corridor, a little longer and wider,
    only finds candidates; they are judged from the origin, so that points on the
    border are in.
    """
    half, gap = width / 2, length / int(length / bin_size)
    reach, wide = length + gap / 1000, half + gap / 1000
    ends = [(F.col(f"o{c}") + side * reach * F.col(f"n{c}")).alias(f"{c}{end}") for end, side in ((0, -1), (1, 1)) for c in "xy"]
    lines = origins.select("tr_id", *ends, *[F.col(c).alias(f"_{c}") for c in ("ox", "oy", "nx", "ny")])
    near = joins.corridor_join(points, lines, wide, 2 * max(wide, gap))
    at = [F.col(c) for c in ("x", "y", "_ox", "_oy", "_nx", "_ny")]
    near = near.withColumns({"distance": g.along(*at), "across": g.across(*at)})
    off, across = F.col("distance") - F.rint(F.col("distance") / gap) * gap, F.col("across")
    seen = near.where(F.col("distance").between(-length, length) & (across <= half) & (off * off + across * across <= half * half)).drop("_ox", "_oy", "_nx", "_ny")
    enough = seen.groupBy("tr_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return seen.join(enough.select("tr_id"), "tr_id", "left_semi").drop("x0", "y0", "x1", "y1", "along")


def overlap_counts(rows: DataFrame, by: list[str], lo: str, hi: str, key: str, width: float) -> DataFrame:
    """key, n: with how many other closed intervals of its group each one overlaps.

    Others that start by my end, less those that end before my start: two running
    counts over marks, dealt by time bucket, with the counts of earlier buckets
    carried over, a row a bucket.  No pair is formed.
    """
    a, b = F.col(lo).cast("double"), F.col(hi).cast("double")
    # at one place: the question what ended before, starts, the question what has started, ends
    marks = F.array(*[F.struct(t.alias("t"), F.lit(side).alias("side")) for t, side in ((a, 0), (a, 1), (b, 2), (b, 3))])
    m = rows.select(*by, key, F.inline(marks)).withColumn("_b", F.floor(F.col("t") / width))
    starts, ends = (F.col("side") == 1).cast("long"), (F.col("side") == 3).cast("long")
    totals = m.groupBy(*by, "_b").agg(F.sum(starts).alias("_s"), F.sum(ends).alias("_e"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carried = totals.select(*by, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_s", "_e")])
    run = Window.partitionBy(*by, "_b").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    at = m.withColumn("_rs", F.sum(starts).over(run)).withColumn("_re", F.sum(ends).over(run)).join(carried, [*by, "_b"])
    asked = at.groupBy(*by, key).agg(
        F.sum(F.when(F.col("side") == 2, F.col("_rs") + F.col("_s")).when(F.col("side") == 0, -(F.col("_re") + F.col("_e")))).alias("n"), F.count_if(F.col("side") == 1).alias("_copies")
    )
    return asked.select(*by, key, (F.col("n") / F.col("_copies") - 1).cast("long").alias("n"))
