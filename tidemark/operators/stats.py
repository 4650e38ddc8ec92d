"""Summaries, climatologies, distributions, quality rules, weights and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.waves import circular_mean


def wave_summary(waves: DataFrame, by: list[str], hs: str = "hs", dp: str = "dp") -> DataFrame:
    """Mean, greatest, percentiles, mean direction and daily trend of each site."""
    hours = F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0
    return waves.groupBy(*by).agg(
        F.count(hs).alias("n"), F.avg(hs).alias("hs_mean"), F.max(hs).alias("hs_max"), F.stddev_pop(hs).alias("hs_std"),
        F.percentile(hs, 0.9).alias("hs_p90"), F.percentile(hs, 0.99).alias("hs_p99"), F.median(hs).alias("hs_median"),
        circular_mean(F.col(dp)).alias("dp_mean"), F.coalesce(F.regr_slope(hs, hours) * 24, F.lit(0.0)).alias("trend_per_day"),
    )


def describe(rows: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """One row a feature: least, greatest, mean, population deviation, median, number of nulls.

    The features are unpivoted, so any number of them is one aggregation.
    """
    long = rows.unpivot(list(by), features, "feature", "v")
    v = F.col("v")
    return long.groupBy(*by, "feature").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.count_if(v.isNull()).alias("n_null"), F.count("*").alias("n"),
    )


def completeness(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Share of values that are there, in percent."""
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return rows.groupBy(*by).agg(F.round(100 * (1 - F.sum(nulls) / (F.count("*") * len(columns))), 6).alias("pct"), F.count("*").alias("n"))


def climatology(rows: DataFrame, date: str, value: str) -> DataFrame:
    """Mean and sample deviation of each month of the year."""
    return rows.groupBy(F.month(date).alias("month")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def month_by_year(rows: DataFrame, date: str, value: str, years: list[int]) -> DataFrame:
    """Means, a row a month, a column a year (the years are named, so no pass is spent on finding them)."""
    x = rows.select(F.month(date).alias("month"), F.year(date).alias("year"), F.col(value).alias("v"))
    out = x.groupBy("month").pivot("year", years).agg(F.avg("v"))
    return out.select("month", *[F.col(f"`{y}`").alias(f"y{y}") for y in years])


def monthly_counts(rows: DataFrame, date: str, hit: Column, by: list[str] = ()) -> DataFrame:
    """Hits a month, 0 for months of the range without any; with ``by`` for each group over its own range."""
    m = F.trunc(date, "month")
    counts = rows.groupBy(*by, m.alias("month")).agg(F.count_if(hit).alias("n"))
    span = rows.groupBy(*by).agg(F.min(m).alias("lo"), F.max(m).alias("hi")).where("lo is not null")
    every = span.select(*by, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return every.join(counts, [*by, "month"], "left").select(*by, "month", F.coalesce("n", F.lit(0)).alias("n"))


def rose(rows: DataFrame, angle: str, weight: str, bins: int = 16) -> DataFrame:
    """Weighted share of each direction bin, in percent."""
    width = 360.0 / bins
    b = rows.where(F.col(angle).isNotNull() & F.col(weight).isNotNull()).groupBy(F.floor(F.pmod(F.col(angle), F.lit(360.0)) / width).cast("int").alias("bin")).agg(F.sum(weight).alias("w"))
    return b.select("bin", F.round(100 * F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("pct"))  # a row a bin


def ecdf(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Share of rows at or below each distinct value, from counts: only distinct values are ranked; with ``by`` within each group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    run = F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*by, value, (run / F.sum("n").over(group)).alias("share"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal bins over the value's range; the greatest value falls into the last."""
    span = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(span)).groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def hexbin(rows: DataFrame, x: str, y: str, nx: int = 50) -> DataFrame:
    """lattice, i, j, n, cx, cy: counts in hexagons, ``nx`` across the range of x.

    Two lattices of rectangles, the second half a step off, hold the hexagons'
    centres; a row goes to the nearer of its nearest centres on each.
    """
    ny = int(nx / 3**0.5)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = both.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))  # one row
    pad = lambda a, b: (F.col(b) - F.col(a)) * 1e-9
    low = {"x": F.col("_x0") - pad("_x0", "_x1"), "y": F.col("_y0") - pad("_y0", "_y1")}
    step = {"x": (F.col("_x1") + pad("_x0", "_x1") - low["x"]) / nx, "y": (F.col("_y1") + pad("_y0", "_y1") - low["y"]) / ny}
    u, v = ((F.col(c) - low[k]) / F.nullif(step[k], F.lit(0.0)) for c, k in ((x, "x"), (y, "y")))
    at = both.join(F.broadcast(span)).select(F.coalesce(u, F.lit(0.0)).alias("u"), F.coalesce(v, F.lit(0.0)).alias("v"), low["x"].alias("lx"), low["y"].alias("ly"), step["x"].alias("sx"), step["y"].alias("sy"))
    near = (F.col("u") - F.rint("u")) ** 2 + 3 * (F.col("v") - F.rint("v")) ** 2
    half = (F.col("u") - F.floor("u") - 0.5) ** 2 + 3 * (F.col("v") - F.floor("v") - 0.5) ** 2
    first = near < half
    place = lambda c: F.when(first, F.rint(c)).otherwise(F.floor(c)).cast("int")
    cells = at.select(F.when(first, 0).otherwise(1).alias("lattice"), place("u").alias("i"), place("v").alias("j"), "lx", "ly", "sx", "sy")
    out = cells.groupBy("lattice", "i", "j").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("lx", "ly", "sx", "sy")])
    off = F.col("lattice") * 0.5
    return out.select("lattice", "i", "j", "n", (F.col("lx") + (F.col("i") + off) * F.col("sx")).alias("cx"), (F.col("ly") + (F.col("j") + off) * F.col("sy")).alias("cy"))


def box(rows: DataFrame, by: list[str], value: str, whisker: float = 1.5) -> DataFrame:
    """by, n, q1, median, q3 and the farthest values within ``whisker`` times their distance beyond them."""
    q = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*by, "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    reach = whisker * (F.col("q3") - F.col("q1"))
    # the greatest value that isn't beyond the upper limit: one aggregation of the values joined with their group's quartiles
    ends = rows.join(q, by).groupBy(*by).agg(
        F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("high")
    )
    return q.join(ends, by)


def return_periods(rows: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """Each year's greatest value with its rank and empirical return period."""
    top = rows.groupBy(*by, F.year(date).alias("year")).agg(F.max(value).alias("annual_max"))
    w = Window.partitionBy(*by)
    r = F.row_number().over(w.orderBy(F.desc("annual_max"), "year"))
    return top.withColumn("rank", r).withColumn("return_period", (F.count("*").over(w) + 1) / F.col("rank"))


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each pair, in one aggregation; rows with a null in the pair don't count."""
    pairs = [(a, b) for a in features for b in features]
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    packed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"c{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(packed))


def range_violations(rows: DataFrame, rules: list[tuple[str, float, float]], tolerance: float = 0.0) -> DataFrame:
    """Rows below and above each feature's range."""
    long = rows.unpivot([], [r[0] for r in rules], "feature", "v")
    low, high = F.create_map(*[x for f, a, _ in rules for x in (F.lit(f), F.lit(float(a)))]), F.create_map(*[x for f, _, b in rules for x in (F.lit(f), F.lit(float(b)))])
    f, v = F.col("feature"), F.col("v")
    return long.groupBy("feature").agg(
        F.count_if(v < low[f] - tolerance).alias("n_below"), F.count_if(v > high[f] + tolerance).alias("n_above"), F.count_if(v.isNull()).alias("n_null"),
    )


def not_monotonic(rows: DataFrame, by: list[str], order: str, value: str, tolerance: float = 0.001) -> DataFrame:
    """Groups whose value falls by more than the tolerance from one row to the next."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_s", step).groupBy(*by).agg(F.count_if(F.col("_s") < -tolerance).alias("n_falls")).where("n_falls > 0")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def class_weights(rows: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Inverse frequencies scaled to sum to the number of classes; a class without rows counts as 1."""
    spark = rows.sparkSession
    classes = spark.range(n_classes).select(F.col("id").cast("int").alias("class"))
    counts = rows.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    inv = classes.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), (1 / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("_i"))
    return inv.select("class", "n", F.round(F.col("_i") * n_classes / F.sum("_i").over(Window.partitionBy()), 6).alias("weight"))  # a row a class


def classification_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy in all (class -1) and of each class, by grouping sets."""
    ok = F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0))
    out = rows.groupingSets([(truth,), ()], truth).agg(F.round(ok, 6).alias("accuracy"), F.count("*").alias("n"))
    return out.select(F.coalesce(F.col(truth).cast("int"), F.lit(-1)).alias("class"), "accuracy", "n")


def regression_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean absolute error, and Pearson's r (0 where a side is constant)."""
    return rows.agg(F.round(F.avg(F.abs(F.col(truth) - F.col(predicted))), 6).alias("mae"), F.round(F.coalesce(F.nanvl(F.corr(truth, predicted), F.lit(0.0)), F.lit(0.0)), 6).alias("r"))
