"""Distributions fitted by maximum likelihood, for each group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_path

STEPS = 25


def weibull(rows: DataFrame, by: list[str], value: str, steps: int = STEPS, tolerance: float = 1e-12) -> DataFrame:
    """by, n, shape, scale of the Weibull distribution from 0 of each group's positive values.

    Equal values are counted first; each of Newton's steps for the shape is one
    aggregation of the counts, with the groups' shapes of the step before as a
    small written table.  A group of one
    distinct value has no shape (null).
    """
    spark = rows.sparkSession
    x = rows.where(F.col(value) > 0).select(*by, F.log(F.col(value).cast("double")).alias("_l"))
    counts = x.groupBy(*by, "_l").agg(F.count("*").alias("_c"))
    path = shared_path(spark, "weibull")
    middle = counts.groupBy(*by).agg((F.sum(F.col("_l") * F.col("_c")) / F.sum("_c")).alias("_m"), F.sum("_c").alias("n"), F.max("_l").alias("_top"), F.min("_l").alias("_low"))
    spread = F.sqrt(F.greatest(F.sum(F.col("_c") * (F.col("_l") - F.col("_m")) ** 2) / F.sum("_c"), F.lit(1e-300)))
    named = lambda s: s.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in s.columns if c not in by])
    on = lambda s: counts.join(named(s), _all_equal(by), "inner")
    first = on(middle).groupBy(*by).agg(F.first("_m").alias("_m"), F.first("n").alias("n"), F.first("_top").alias("_top"), F.first("_low").alias("_low"), (math.pi / math.sqrt(6) / spread).alias("shape"))
    first.withColumn("_step", F.lit(1.0)).write.parquet(f"{path}/0")
    for i in range(steps):
        s = spark.read.parquet(f"{path}/{i}")
        w = F.col("_c") * F.exp(F.col("shape") * (F.col("_l") - F.col("_top")))  # powers off the greatest value can't overflow
        sums = on(s).groupBy(*by).agg(
            F.sum(w).alias("_a"), F.sum(w * F.col("_l")).alias("_b"), F.sum(w * F.col("_l") ** 2).alias("_d"), *[F.first(c).alias(c) for c in ("_m", "n", "_top", "_low", "shape")]
        )
        k, mean = F.col("shape"), F.col("_b") / F.col("_a")
        slope = F.col("_d") / F.col("_a") - mean**2 + 1 / k**2
        step = (mean - 1 / k - F.col("_m")) / slope
        now = F.greatest(k - step, k / 3)
        sums.select(*by, "_m", "n", "_top", "_low", now.alias("shape"), (F.abs(now - k) / k).alias("_step")).write.parquet(f"{path}/{i + 1}")
        last = spark.read.parquet(f"{path}/{i + 1}")
        if (last.where("_low < _top").agg(F.max("_step")).first()[0] or 0.0) < tolerance:
            break
    power = F.log(F.sum(F.col("_c") * F.exp(F.col("shape") * (F.col("_l") - F.col("_top")))) / F.sum("_c")) / F.first("shape") + F.first("_top")
    out = on(last).groupBy(*by).agg(F.first("n").alias("n"), F.when(F.first("_low") < F.first("_top"), F.first("shape")).alias("shape"), F.exp(power).alias("scale"))
    return out.select(*by, "n", "shape", F.when(F.col("shape").isNotNull(), F.col("scale")).alias("scale"))


def _all_equal(by: list[str]):
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on


def _minus_log_likelihood(p: np.ndarray, x: np.ndarray) -> float:
    shape, place, scale = p[0], p[1], math.exp(p[2])
    y = (x - place) / scale
    if abs(shape) < 1e-9:
        return len(x) * p[2] + float(np.sum(y + np.exp(-y)))
    inner = 1 - shape * y
    if inner.min() <= 0:
        return math.inf
    l = np.log(inner) / shape
    return len(x) * p[2] + float(np.sum(np.exp(l) - (1 - shape) * l))


def fit_extremes(x: np.ndarray, steps: int = 200) -> tuple[float, float, float]:
    """shape, place and scale of the generalised extreme-value distribution F = exp(-(1 - shape * y)**(1 / shape)).

    Newton's method on the likelihood, with central differences and halved
    steps, from the moments of Gumbel's distribution.
    """
    x = np.asarray(x, float)
    scale = math.sqrt(6) * x.std() / math.pi
    centre, unit = x.mean(), max(x.std(), 1e-300)
    z = (x - centre) / unit
    p = np.array([0.1, -0.5772156649015329 * scale / unit, math.log(max(scale / unit, 1e-12))])
    f = lambda q: _minus_log_likelihood(q, z)
    if not math.isfinite(f(p)):
        p[0] = 0.0
    h = 1e-4
    for _ in range(steps):
        e = np.eye(3) * h
        g = np.array([(f(p + e[i]) - f(p - e[i])) / (2 * h) for i in range(3)])
        H = np.array([[(f(p + e[i] + e[j]) - f(p + e[i] - e[j]) - f(p - e[i] + e[j]) + f(p - e[i] - e[j])) / (4 * h * h) for j in range(3)] for i in range(3)])
        if not (np.isfinite(g).all() and np.isfinite(H).all()):
            break
        values, vectors = np.linalg.eigh((H + H.T) / 2)
        d = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-8))
        size, now = 1.0, f(p)
        while size > 1e-12 and not f(p - size * d) < now:
            size /= 2
        if size <= 1e-12 or np.abs(size * d).max() < 1e-11:
            break
        p = p - size * d
    return float(p[0]), float(p[1] * unit + centre), float(math.exp(p[2]) * unit)


def extremes(rows: DataFrame, by: list[str], date: str, value: str, periods: tuple[int, ...] = (2, 5, 10, 20, 50, 100), least: int = 3) -> DataFrame:
    """by, n, shape, place, scale, period, level: the extreme-value fit of each group's annual maxima and its return levels.

    A group holds a row a year; with fewer than ``least`` years, or equal ones, the fit is null.
    """
    top = rows.where(F.col(value).isNotNull()).groupBy(*by, F.year(date).alias("_y")).agg(F.max(F.col(value).cast("double")).alias("_v"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf["_v"].to_numpy())
        fit = fit_extremes(v) if len(v) >= least and v[0] < v[-1] else (np.nan,) * 3
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "n": len(v), "shape": fit[0], "place": fit[1], "scale": fit[2]}])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    fits = top.groupBy(*by).applyInPandas(fitted, f"{kinds}, n long, shape double, place double, scale double")
    clean = fits.select(*by, "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("shape", "place", "scale")])
    out = clean.withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    rare = -F.log(1 - 1 / F.col("period"))
    level = F.when(F.abs("shape") < 1e-9, F.col("place") - F.col("scale") * F.log(rare)).otherwise(F.col("place") + F.col("scale") * (1 - F.pow(rare, F.col("shape"))) / F.col("shape"))
    return out.withColumn("level", level)
