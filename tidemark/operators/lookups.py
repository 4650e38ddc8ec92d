"""Look-ups along profiles, pruning by bounds, padded bins, sample weights and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .history import interpolated


def value_at(at: Column, points: Column) -> Column:
    """Value at ``at`` on the line through sorted points (x, v); outside them that of the nearest point."""
    near = F.array_min(F.transform(points, lambda p: F.struct(F.abs(p["x"] - at).alias("off"), p["x"].alias("x"), p["v"].alias("v"))))
    return F.coalesce(interpolated(at, points), near["v"])


def lines_of(rows: DataFrame, by: list[str], x: str, value: str, name: str = "points") -> DataFrame:
    """One row a profile with its points (x, v) in order; nulls are left out."""
    whole = rows.where(F.col(x).isNotNull() & F.col(value).isNotNull())
    return whole.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("v")))).alias(name))  # one profile


def change_on_second(first: DataFrame, second: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Differences of two surveys at the second one's places; the first is read between its points and kept level beyond its ends."""
    both = second.join(lines_of(first, by, x, value, "_line"), by)
    diff = F.col(value) - value_at(F.col(x), F.col("_line"))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return both.withColumn("_d", diff).groupBy(*by).agg(some(F.avg("_d")).alias("mean_change"), some(F.max("_d")).alias("max_gain"), some(F.min("_d")).alias("max_loss"), some(F.stddev_pop("_d")).alias("std_change"))


def prune_files(files: DataFrame, lines: DataFrame, buffer: float) -> DataFrame:
    """Files whose stored bounds (x_min, y_min, x_max, y_max) touch the lines' bounds; those without bounds stay."""
    ends = lambda f, a, b: f(F.col(a), F.col(b))
    total = lines.agg(
        F.min(ends(F.least, "x0", "x1")).alias("_x0"), F.min(ends(F.least, "y0", "y1")).alias("_y0"), F.max(ends(F.greatest, "x0", "x1")).alias("_x1"), F.max(ends(F.greatest, "y0", "y1")).alias("_y1")
    )
    near = g.boxes_overlap(("x_min", "y_min", "x_max", "y_max"), ("_x0", "_y0", "_x1", "_y1"), buffer)
    return files.join(F.broadcast(total), F.col("x_min").isNull() | near, "left_semi")  # one row


def pad_bins(bins: DataFrame, by: list[str], n_bins: str, first: str, width: str, size: float, max_bins: int) -> DataFrame:
    """Bins 0 .. max_bins - 1 of each profile; centres go on by ``size`` beyond its own, where ``valid`` is false and values are 0."""
    own = bins.groupBy(*by).agg(F.first(n_bins).alias("_n"), F.first(first).alias("_lo"), F.first(width).alias("_w"))
    full = own.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max_bins - 1))))
    inside = F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")
    beyond = F.col("_lo") + (F.col("_n") - 0.5) * F.col("_w") + (F.col("bin") - F.col("_n") + 1) * size
    out = full.join(bins.select(*by, "bin", "mean", "valid"), [*by, "bin"], "left")
    return out.select(*by, "bin", F.when(F.col("bin") < F.col("_n"), inside).otherwise(beyond).alias("centre"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("valid", F.lit(False)).alias("valid"))


def voxel_metadata(bins: DataFrame, by: list[str]) -> DataFrame:
    """Height, slopes and toe of a profile from its valid bins; from the first bin where none is valid."""
    some = bins.groupBy(*by).agg(F.max("valid").alias("_any"), F.min("bin").alias("_first"))
    kept = bins.join(some, by).where(F.col("valid") | (~F.col("_any") & (F.col("bin") == F.col("_first"))))
    return kept.groupBy(*by).agg((F.max("mean") - F.min("mean")).alias("cliff_height"), F.avg(F.abs("slope")).alias("mean_slope"), F.max(F.abs("slope")).alias("max_slope"), F.min_by("mean", "bin").alias("toe_elevation"))


def sample_weights(rows: DataFrame, key: str, label: str, observed: Column, boost: float = 1.5) -> DataFrame:
    """One over the size of a row's class, more for observed rows."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(sizes), label).select(key, ((1.0 / F.col("_n")) * F.when(observed, boost).otherwise(1.0)).alias("weight"))  # a row a class


def quality_report(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """check, n_checked, n_failed, passed: each check counts the rows for which its condition fails; null fails."""
    one = lambda name, rows, ok: rows.agg(F.lit(name).alias("check"), F.count("*").alias("n_checked"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed"))
    parts = [one(name, rows, ok) for name, (rows, ok) in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("n_failed") == 0)


def density(rows: DataFrame, by: list[str], value: str, n: int = 30) -> DataFrame:
    """by, bin, density of n even bins over the range of all rows; a group's densities times the width sum to 1."""
    limits = rows.agg(F.min(value).alias("_lo"), ((F.max(value) - F.min(value)) / n).alias("_w"))
    x = rows.where(F.col(value).isNotNull()).join(F.broadcast(limits))  # one row
    binned = x.groupBy(*by, F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count("*").alias("_n"), F.first("_w").alias("_w"))
    total = binned.groupBy(*by).agg(F.sum("_n").alias("_t"))
    return binned.join(total, by).select(*by, "bin", (F.col("_n") / F.col("_t") / F.col("_w")).alias("density"))


def with_aliases(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """The named columns, each from the first of its aliases that the table has; null where it has none."""
    pick = lambda name, aliases: next((F.col(f"`{a}`") for a in aliases if a in rows.columns), F.lit(None).cast("double")).alias(name)
    return rows.select(*[pick(name, aliases) for name, aliases in names.items()])


def events_or_queued(cells: DataFrame, events: DataFrame, key: list[str], event: str, order: str) -> DataFrame:
    """key, event, source: the foremost event (greatest ``order``, then smallest id) of each cell, else the foremost of all."""
    first = F.max_by(F.col(event), F.struct(order, -F.col(event)))
    own = events.groupBy(*key).agg(first.alias("_own"))
    queued = events.agg(first.alias("_queued"))
    out = cells.select(*key).join(own, key, "left").join(F.broadcast(queued))  # one row
    return out.select(*key, F.coalesce("_own", "_queued").alias(event), F.when(F.col("_own").isNull(), "queue").otherwise("cell").alias("source"))
