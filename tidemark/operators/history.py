"""Summaries of series between surveys, training samples and their look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lab
from ..functions import waves as w
from . import joins, samples, series


def wave_metrics(waves: DataFrame, by: list[str], orientation: float = 270.0, threshold: float = 2.0, ts: str = "ts") -> DataFrame:
    """One row of summary metrics for each window of waves: means, integrals, extremes, storms and the trend a day.

    Rows are hourly.  Without a storm durations are 0 and the time since the last
    one is the number of rows.
    """
    hs, tp, dp = F.col("hs"), F.col("tp"), F.col("dp")
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    hours = F.floor(seconds(ts) / 3600)
    both = hs.isNotNull() & tp.isNotNull()
    whole = waves.groupBy(*by).agg(
        F.avg(hs).alias("hs_m"), F.avg(tp).alias("tp_s"), w.circular_mean(dp).alias("dp_deg"), F.avg(w.power(hs, tp)).alias("power_kw"), F.avg(w.power(hs, tp)).alias("mean_power_kw"), F.avg(w.shore_normal(hs, dp, F.lit(orientation))).alias("shore_normal_hs_m"),
        F.avg(F.when(both, w.runup(hs, tp))).alias("runup_2pct_m"), (F.sum(w.energy(hs)) * 3600 / 1e6).alias("cumulative_energy_mj"), F.sum(w.power(hs, tp)).alias("cumulative_power_kwh"),
        F.max(hs).alias("max_hs_m"), F.percentile(hs, 0.9).alias("hs_p90"), F.percentile(hs, 0.99).alias("hs_p99"), F.count_if(hs >= threshold).alias("storm_hours"),
        F.max(hs).alias("rolling_max_7d_m"), F.coalesce(F.regr_slope(hs, hours) * 24, F.lit(0.0)).alias("hs_trend_slope"), F.max(ts).alias("_last"), F.count("*").alias("_n"),
    )
    found = series.storms(waves, by, ts, "hs", threshold).groupBy(*by).agg(F.count("*").alias("storms"), F.max("hours").alias("longest"), F.avg("hours").alias("mean"), F.max("end").alias("_end"))
    x = whole.join(found, by, "left")
    since = F.when(F.col("_end").isNull(), F.col("_n").cast("double")).otherwise(F.greatest(F.lit(0.0), (seconds("_last") - seconds("_end")) / 3600))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.select(
        *[c for c in whole.columns if c[0] != "_"], F.coalesce("storms", F.lit(0)).alias("storm_count"), zero("longest").alias("max_storm_duration_hr"),
        zero("mean").alias("mean_storm_duration_hr"), since.alias("time_since_storm_hr"),
    )


def epoch_features(waves: DataFrame, by: list[str]) -> DataFrame:
    """Features of the waves between two surveys; missing heights count in the shares' denominator.

    Net radiation stress is the sum of ``sxy`` and ``sxx`` where the waves have them, else null.
    """
    hs, tp, dp = F.col("hs"), F.col("tp"), F.col("dp")
    net = lambda c: (F.coalesce(F.sum(c), F.lit(0.0)) if c in waves.columns else F.lit(None).cast("double")).alias(f"{c}_net")
    p = w.power(hs, tp)
    over = lambda limit: F.count_if(hs > limit)
    return waves.groupBy(*by).agg(
        F.avg(hs).alias("hs_mean"), F.median(hs).alias("hs_median"), F.stddev_pop(hs).alias("hs_std"), F.max(hs).alias("hs_max"), F.percentile(hs, 0.9).alias("hs_90q"), F.percentile(hs, 0.95).alias("hs_95q"),
        F.avg(tp).alias("tp_mean"), F.max(tp).alias("tp_max"), F.avg(p).alias("power_mean"), F.max(p).alias("power_max"), F.coalesce(F.sum(p), F.lit(0.0)).alias("power_cumulative"),
        over(3.0).alias("storm_hours_3m"), over(4.0).alias("storm_hours_4m"), (over(2.0) / F.count("*")).alias("high_energy_fraction"), w.circular_mean(dp).alias("dp_mean"),
        F.degrees(F.stddev_pop(F.radians(dp))).alias("dp_spread"), net("sxy"), net("sxx"), F.count(hs).alias("n_valid_hours"), (F.count(hs) / F.count("*")).alias("data_coverage"),
    )


def cliff_metrics(detections: DataFrame, by: list[str]) -> DataFrame:
    """Rates, widths and confidences of detected cliffs (has_cliff, toe, top, toe_confidence, top_confidence); a null toe is not valid."""
    x = detections.where(F.col("toe").isNotNull())
    found, width = F.col("has_cliff"), F.when(F.col("has_cliff"), F.col("top") - F.col("toe"))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    sure = lambda c: F.when(found, F.col(c))
    return x.groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.count_if(found).alias("n_detected"), (F.count_if(found) / F.count("*")).alias("detection_rate"), some(F.avg(width)).alias("mean_cliff_width_m"),
        some(F.stddev_pop(width)).alias("std_cliff_width_m"), some(F.min(width)).alias("min_cliff_width_m"), some(F.max(width)).alias("max_cliff_width_m"),
        some(F.avg(sure("toe_confidence"))).alias("mean_toe_confidence"), some(F.avg(sure("top_confidence"))).alias("mean_top_confidence"),
    )


def matching_pair(events: DataFrame, epochs: DataFrame, key: str, near: int = 7) -> DataFrame:
    """key, pair: the first pair of neighbouring epochs that holds an event, or whose dates both lie within ``near`` days; null without one.

    Each pair names the months in which such an event can start, so the join is
    on the month, with the exact rule beside it.  Pairs number as the surveys do.
    """
    later = F.lead("epoch_date").over(Window.orderBy("epoch_idx"))  # a row a survey
    pairs = epochs.select(F.col("epoch_idx").alias("pair"), F.col("epoch_date").alias("first"), later.alias("second")).where("second is not null")
    months = F.sequence(F.trunc(F.date_sub("first", near), "month"), F.trunc(F.greatest("second", F.date_add("first", near)), "month"), F.expr("interval 1 month"))
    spread = pairs.withColumn("month", F.explode(months))
    start, end = F.col("start_date"), F.col("end_date")
    within = (F.col("first") <= start) & (F.col("second") >= end)
    close = (F.abs(F.datediff("first", start)) <= near) & (F.abs(F.datediff("second", end)) <= near)
    found = events.withColumn("month", F.trunc("start_date", "month")).join(spread, "month").where(within | close).groupBy(key).agg(F.min("pair").alias("pair"))
    return events.select(key).join(found, key, "left")


def events_of_pairs(events: DataFrame, pairs: DataFrame, tolerance: float = 0.15, key: str = "event_id") -> DataFrame:
    """Every event of each transect's pair of epochs, numbered by falling volume.

    ``events`` have lo and hi along the shore, start_date, end_date and volume;
    ``pairs`` have transect_idx, place, first and second.  An event belongs to a
    pair whose transect lies in its span, widened by the tolerance, and whose
    dates hold its own.
    """
    e = events.withColumn("_lo", F.col("lo") - tolerance).withColumn("_hi", F.col("hi") + tolerance)
    p = pairs.withColumn("_at", F.col("place"))
    met = joins.rectangle_overlap(e, p, [("_lo", "_hi", "place", "_at", 1.0), ("start_date", "end_date", "first", "second", 92.0)])
    held = met.where((F.col("start_date") >= F.col("first")) & (F.col("end_date") <= F.col("second")))
    order = Window.partitionBy("transect_idx", "first", "second").orderBy(F.desc("volume"), key)
    return held.withColumn("position", F.row_number().over(order)).drop("_lo", "_hi", "_at")


def pair_queue(events: DataFrame, transects: DataFrame, epochs: DataFrame, limit: int = 2000, tolerance: float = 0.15) -> DataFrame:
    """The largest event of each transect and pair of neighbouring epochs, largest first, at most ``limit``.

    An event (event_id, place, start_date, end_date, volume) goes to the nearest
    transect (idx, place_of) within the tolerance and the first pair that matches it.
    """
    near = joins.nearest_within(events, transects, ["event_id"], "place", "place_of", ["idx"], tolerance).where("idx is not null")
    placed = near.join(matching_pair(near, epochs, "event_id").where("pair is not null"), "event_id")
    return samples.queue(placed, ["idx", "pair"], limit)


def align_events(events: DataFrame, epochs: DataFrame, cells: DataFrame) -> DataFrame:
    """Events (transect_idx, start_date, end_date) between the epochs that bracket them, where both of the transect's cells are covered."""
    found = joins.bracket(events, epochs, "start_date", "end_date", "epoch_date", "epoch_idx")
    covered = cells.select("transect_idx", "epoch_idx").distinct()
    for side in ("epoch_before", "epoch_after"):
        found = found.join(covered.withColumnRenamed("epoch_idx", side), ["transect_idx", side], "left_semi")
    return found


def events_by_cell(aligned: DataFrame) -> DataFrame:
    """transect_idx, epoch_idx, volume, event_class: aligned events by the cell they end at.

    Events of one (transect, before, after) are added up first, and the class is
    that of their sum; of several such groups of a cell the volumes add up, the
    class is that of the group with the earliest epoch before.
    """
    groups = samples.aggregate_events(aligned, ["transect_idx", "epoch_before", "epoch_after"])
    out = groups.groupBy("transect_idx", F.col("epoch_after").alias("epoch_idx"))
    return out.agg(F.sum("volume").alias("volume"), F.min_by("event_class", "epoch_before").alias("event_class"))


def training_samples(cells: DataFrame, events: DataFrame, most: int = 10, least: int = 3) -> DataFrame:
    """A sample for each covered cell (transect_idx, epoch_idx, value) with at least ``least`` earlier ones.

    ``events`` are those of ``events_by_cell``.  Context values (padded in
    front), their number, the volume and class of the observed events (else 0, 0
    and confidence 0.5), and risk and collapse labels; the value of the latest
    context cell is the cliff's height.
    """
    x = samples.context(cells, ["transect_idx"], "epoch_idx", "value", most, least).join(events, ["transect_idx", "epoch_idx"], "left")
    seen, volume = F.col("volume").isNotNull(), F.coalesce("volume", F.lit(0.0))
    height = F.element_at("context", -1).cast("double")
    return x.select(
        "transect_idx", F.col("epoch_idx").alias("target_epoch"), "context", "n_context", volume.alias("total_volume"), F.coalesce("event_class", F.lit(0)).alias("event_class"),
        lab.risk_index(volume, height).alias("risk_index"), lab.collapse_labels(volume).alias("collapse"), seen.cast("int").alias("label_source"), F.when(seen, 1.0).otherwise(0.5).alias("confidence"),
    )


def common_range(rows: DataFrame, by: list[str], epoch: str, x: str, value: str) -> DataFrame:
    """by, lo, hi: the range of x that all epochs with values share; none where it is empty."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, epoch).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    return each.groupBy(*by).agg(F.max("a").alias("lo"), F.min("b").alias("hi")).where("hi > lo")


def interpolated(at: Column, points: Column) -> Column:
    """Value at ``at`` on the line through sorted points (x, v); null outside them."""
    left = F.try_element_at(F.filter(points, lambda p: p["x"] <= at), F.lit(-1))
    right = F.get(F.filter(points, lambda p: p["x"] >= at), 0)
    slope = (right["v"] - left["v"]) / (right["x"] - left["x"])
    return F.when(left.isNull() | right.isNull(), None).when(right["x"] == left["x"], left["v"]).otherwise(left["v"] + slope * (at - left["x"]))


def on_common_grid(rows: DataFrame, by: list[str], epoch: str, x: str, value: str, n: int) -> DataFrame:
    """by, epoch, k, x, value: every epoch with two values or more on n even places of the shared range."""
    limits = common_range(rows, by, epoch, x, value)
    lines = rows.where(F.col(value).isNotNull()).groupBy(*by, epoch).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("v")))).alias("p")).where(F.size("p") > 1)  # one profile
    grid = lines.join(limits, by).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (n - 1))
    return grid.select(*by, epoch, "k", F.col("at").alias("x"), interpolated(F.col("at"), F.col("p")).alias("value"))


def next_unlabelled(rows: DataFrame, by: list[str], order: str, labelled: str) -> DataFrame:
    """Append next_order: the next row without a label, from the start again after the last; null where all have one."""
    own = F.when(~F.col(labelled), F.col(order))
    back = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)  # a running value, whatever lies ahead
    return rows.withColumn("next_order", F.coalesce(F.last(own, True).over(back), F.min(own).over(Window.partitionBy(*by))))
