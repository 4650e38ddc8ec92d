"""Profiles along a line: rows (keys, i, distance, elevation) and their derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def _order(by: list[str], i: str = "i"):
    return Window.partitionBy(*by).orderBy(i)


def _whole(by: list[str]):
    return Window.partitionBy(*by)


def smooth(profile: DataFrame, by: list[str], z: str = "elevation", name: str = "smoothed") -> DataFrame:
    """Mean of five points; the two at each end keep their value."""
    o = _order(by)
    n, r = F.count("*").over(_whole(by)), F.row_number().over(o)
    inner = (r > 2) & (r <= n - 2)
    return profile.withColumn(name, F.when(inner, F.avg(z).over(o.rowsBetween(-2, 2))).otherwise(F.col(z)))


def slope_and_curvature(profile: DataFrame, by: list[str], z: str = "smoothed", d: str = "distance") -> DataFrame:
    """Append slope (degrees) and curvature: central differences, one-sided slopes at the ends, ends copy their neighbour's curvature."""
    o, every = _order(by), _whole(by)
    n = F.count("*").over(every)
    dx = F.greatest((F.max(d).over(every) - F.min(d).over(every)) / F.greatest(n - 1, F.lit(1)), F.lit(0.01))
    x = profile.withColumn("_dx", dx).withColumn("_p", F.lag(z).over(o)).withColumn("_q", F.lead(z).over(o))
    first = F.when(F.col("_p").isNull(), (F.col("_q") - F.col(z)) / F.col("_dx")).when(F.col("_q").isNull(), (F.col(z) - F.col("_p")) / F.col("_dx"))
    x = x.withColumn("_g", F.coalesce(first, (F.col("_q") - F.col("_p")) / (2 * F.col("_dx"))))
    second = (F.col("_q") - 2 * F.col(z) + F.col("_p")) / (F.col("_dx") * F.col("_dx"))
    x = x.withColumn("_c", second / F.pow(1 + F.col("_g") * F.col("_g"), F.lit(1.5)))
    c = F.coalesce("_c", F.when(F.col("_p").isNull(), F.lead("_c").over(o)).otherwise(F.lag("_c").over(o)), F.lit(0.0))
    x = x.withColumn("slope", F.degrees(F.atan(F.coalesce("_g", F.lit(0.0))))).withColumn("curvature", F.least(F.greatest(c, F.lit(-10.0)), F.lit(10.0)))
    return x.drop("_dx", "_p", "_q", "_g", "_c")


def roughness(profile: DataFrame, by: list[str], z: str = "elevation", d: str = "distance") -> DataFrame:
    """Append the standard deviation of what a straight line leaves in five points, fewer at the ends: a closed form over window sums."""
    f = _order(by).rowsBetween(-2, 2)
    vz, vd, cov = F.var_pop(z).over(f), F.var_pop(d).over(f), F.covar_pop(d, z).over(f)
    left = vz - F.when(vd > 0, cov * cov / vd).otherwise(0.0)
    return profile.withColumn("roughness", F.sqrt(F.greatest(left, F.lit(0.0))))


def gradient(profile: DataFrame, by: list[str], z: str, d: str, name: str) -> DataFrame:
    """Second-order derivative estimate for uneven spacing, one-sided at the ends."""
    o = _order(by)
    h1, h2 = F.col(d) - F.lag(d).over(o), F.lead(d).over(o) - F.col(d)
    below, above = F.col(z) - F.lag(z).over(o), F.lead(z).over(o) - F.col(z)
    inner = (above / h2 * h1 + below / h1 * h2) / (h1 + h2)
    return profile.withColumn(name, F.coalesce(inner, above / h2, below / h1))


def cliff_features(profile: DataFrame, by: list[str], z: str = "elevation", d: str = "distance", low: float = 15.0, reach: int = 20) -> DataFrame:
    """Append the profile features a cliff detector reads."""
    o, every = _order(by), _whole(by)
    scaled = lambda x: (F.col(x) - F.min(x).over(every)) / (F.max(x).over(every) - F.min(x).over(every) + EPS)
    unit = lambda x: F.col(x) / (F.stddev_pop(x).over(every) + EPS)
    x = profile.withColumn("distance_norm", scaled(d)).withColumn("elevation_norm", scaled(z))
    x = gradient(x, by, z, d, "_g1")
    x = gradient(x, by, "_g1", d, "_g2")
    x = x.withColumn("gradient", unit("_g1")).withColumn("second_gradient", unit("_g2"))
    sea, land = o.rowsBetween(-reach, -1), o.rowsBetween(0, reach - 1)
    tilt = lambda f: F.degrees(F.atan((F.last(z).over(f) - F.first(z).over(f)) / F.nullif(F.last(d).over(f) - F.first(d).over(f), F.lit(0.0))))
    x = x.withColumn("seaward_slope", F.greatest(F.coalesce(tilt(sea), F.lit(0.0)), F.lit(0.0)) / 90)
    x = x.withColumn("landward_slope", F.greatest(F.coalesce(tilt(land), F.lit(0.0)), F.lit(0.0)) / 90)
    z0, z1 = F.first(z).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(z).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("trend_deviation", F.col(z) - (z0 + (z1 - z0) * F.col("distance_norm"))).withColumn("slope_change", F.col("landward_slope") - F.col("seaward_slope"))
    x = x.withColumn("convexity", F.when(F.col("second_gradient") < 0, 1.0).otherwise(0.0)).withColumn("low_zone", F.when(F.col(z) < low, 1.0).otherwise(0.0))
    x = x.withColumn("shore_proximity", F.exp(-5 * F.col("distance_norm"))).withColumn("_m", F.max(F.abs("gradient")).over(o.rowsBetween(-2, 2)))
    return x.withColumn("max_local_gradient", scaled("_m")).drop("_g1", "_g2", "_m")


def toe_and_top(scored: DataFrame, by: list[str], d: str, p_toe: str, p_top: str, threshold: float = 0.5) -> DataFrame:
    """Each profile's likeliest toe and top; has_cliff needs both above the threshold and the top beyond the toe."""
    best = scored.groupBy(*by).agg(F.max_by(d, p_toe).alias("toe"), F.max(p_toe).alias("toe_confidence"), F.max_by(d, p_top).alias("top"), F.max(p_top).alias("top_confidence"))
    return best.withColumn("has_cliff", (F.col("toe_confidence") > threshold) & (F.col("top_confidence") > threshold) & (F.col("top") > F.col("toe")))


def regrid(profile: DataFrame, by: list[str], n: int, values: list[str], nearest: list[str] = (), d: str = "distance", start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """n evenly spaced points a profile: straight lines for ``values``, the nearer point (the lower of equals) for ``nearest``.

    Targets are bracketed within each profile's own sorted points; a target
    beyond them takes the end's value.  ``start`` and ``stop`` are aggregates
    over the profile; without them its own range is used.
    """
    point = F.struct(F.col(d).cast("double").alias("d"), *[F.col(v).cast("double").alias(v) for v in [*values, *nearest]])
    lo, hi = (F.min(d) if start is None else start).cast("double"), (F.max(d) if stop is None else stop).cast("double")
    p = profile.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("_p"), lo.alias("_lo"), hi.alias("_hi"))
    grid = p.select(*by, "_p", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / max(1, n - 1))).alias("i", "distance"))
    a = F.coalesce(F.array_max(F.filter("_p", lambda q: q["d"] <= F.col("distance"))), F.get("_p", F.lit(0)))
    b = F.coalesce(F.array_min(F.filter("_p", lambda q: q["d"] >= F.col("distance"))), F.element_at("_p", -1))
    grid = grid.withColumn("_a", a).withColumn("_b", b)
    share = F.coalesce((F.col("distance") - F.col("_a.d")) / F.nullif(F.col("_b.d") - F.col("_a.d"), F.lit(0.0)), F.lit(0.0))
    lines = [(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share).alias(v) for v in values]
    near = [F.when(share <= 0.5, F.col(f"_a.{v}")).otherwise(F.col(f"_b.{v}")).alias(v) for v in nearest]
    return grid.select(*by, "i", "distance", *lines, *near)


def summary(profile: DataFrame, by: list[str], z: str = "elevation", slope: str = "slope", intensity: str | None = None) -> DataFrame:
    """Height, mean and greatest slope, first and last elevation of each profile."""
    aggs = [
        (F.max(z) - F.min(z)).alias("height"), F.avg(F.abs(slope)).alias("mean_slope"), F.max(F.abs(slope)).alias("max_slope"),
        F.min_by(z, "i").alias("first_elevation"), F.max_by(z, "i").alias("last_elevation"), F.count("*").alias("n_points"),
    ]
    return profile.groupBy(*by).agg(*aggs, *([F.avg(intensity).alias("mean_intensity")] if intensity else []))


def dominant(rows: DataFrame, by: list[str], value: str, name: str = "dominant") -> DataFrame:
    """The commonest value of each group, the smallest of equals."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name), F.max("_n").alias("n"))


def voxel_bins(points: DataFrame, by: list[str], size: float, max_bins: int = 128, min_points: int = 3, d: str = "distance", z: str = "elevation") -> DataFrame:
    """Statistics of each bin along a profile; bins below ``min_points`` have zeros and valid = false."""
    every = _whole(by)
    x = points.withColumn("_lo", F.min(d).over(every)).withColumn("_hi", F.max(d).over(every))
    n = F.least(F.greatest(F.floor((F.col("_hi") - F.col("_lo")) / size), F.lit(1)), F.lit(max_bins)).cast("int")
    x = x.withColumn("_bins", n).withColumn("_w", F.greatest((F.col("_hi") - F.col("_lo")) / F.col("_bins"), F.lit(EPS)))
    x = x.withColumn("bin", F.least(F.floor((F.col(d) - F.col("_lo")) / F.col("_w")), F.col("_bins") - 1).cast("int"))
    out = x.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("std"), (F.max(z) - F.min(z)).alias("range"),
        F.degrees(F.atan(F.coalesce(F.regr_slope(z, d), F.lit(0.0)))).alias("slope"), (F.var_pop(z) / (size * size)).alias("roughness"), F.first("_lo").alias("_lo"), F.first("_w").alias("_w"),
    )
    ok = F.col("n") >= min_points
    stats = [F.when(ok, F.col(c)).otherwise(0.0).alias(c) for c in ("mean", "std", "range", "slope", "roughness")]
    return out.select(*by, "bin", "n", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("centre"), *stats, ok.alias("valid"))
