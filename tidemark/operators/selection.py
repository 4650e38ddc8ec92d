"""Picking rows: samples, representatives, grid look-ups, islands, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement, in proportion to the weights; repeatable.  ``draw`` numbers them.

    The draws are points in [0, total); rows own intervals of it.  Intervals come
    from sums of slices of the key's hash, so only slice sums are ordered in one
    place, and draws meet rows by slice.
    """
    slices = 1024
    s = rows.where(F.col(weight) > 0).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(slices)))
    sums = s.groupBy("_s").agg(F.sum(weight).alias("_w"))  # at most 1024 rows
    run = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_hi", F.sum("_w").over(run)).withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = sums.agg(F.max("_hi").alias("_t"))
    u = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(2**40)) / F.lit(2.0**40)
    draws = rows.sparkSession.range(n).join(F.broadcast(total)).select(F.col("id").alias("draw"), (u * F.col("_t")).alias("_u"))
    placed = draws.join(F.broadcast(sums), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", "_s", (F.col("_u") - F.col("_lo")).alias("_u"))
    inside = Window.partitionBy("_s").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = s.withColumn("_b", F.sum(weight).over(inside)).withColumn("_a", F.col("_b") - F.col(weight))
    return placed.join(own, "_s").where("_u >= _a and _u < _b").drop("_s", "_u", "_a", "_b")


def representatives(rows: DataFrame, by: list[str], order: str, key: str, n: int) -> DataFrame:
    """n rows of each group, evenly spaced in the order of a value."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("_r", F.row_number().over(w.orderBy(order, key)) - 1).withColumn("_step", F.greatest(F.floor(F.count("*").over(w) / n), F.lit(1)))
    pick = (F.pmod(F.col("_r") - F.floor(F.col("_step") / 2), F.col("_step")) == 0) & (F.floor(F.col("_r") / F.col("_step")) < n)
    return x.where(pick).drop("_r", "_step")


def middle(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The row of each group whose value is nearest to the middle of its range."""
    mid = rows.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias("_mid"))
    best = rows.join(mid, by).groupBy(*by).agg(F.min_by(F.struct(key, value), F.struct(F.abs(F.col(value) - F.col("_mid")), key)).alias("_b"))
    return best.select(*by, f"_b.{key}", f"_b.{value}")


def grid_values(points: DataFrame, grid: DataFrame, x0: float, y0: float, size: float, nodata: float | None = None) -> DataFrame:
    """Points (x, y) with the value of their grid cell (row, col, value); null outside and for nodata."""
    at = points.withColumn("col", F.floor((F.col("x") - x0) / size).cast("int")).withColumn("row", F.floor((y0 - F.col("y")) / size).cast("int"))
    v = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    return at.join(grid.select("row", "col", v.alias("value")), ["row", "col"], "left")


def candidate_labels(ids: DataFrame, key: str, width: tuple[int, ...] = (0, 4, 5)) -> DataFrame:
    """Possible site labels of each id: its number with several zero paddings."""
    forms = F.array_distinct(F.array(*[F.concat(F.lit("D"), F.lpad(F.col(key).cast("string"), w, "0") if w else F.col(key).cast("string")) for w in width]))
    return ids.select(key, F.explode(forms).alias("label"))


def availability(expected: DataFrame, listing: DataFrame, key: str, n_rows: str) -> DataFrame:
    """key, status of each expected id: valid, invalid (there, without rows) or missing."""
    found = listing.groupBy(key).agg(F.max(n_rows).alias("_n"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 0, "valid").otherwise("invalid")
    return expected.join(found, key, "left").select(key, status.alias("status"))


def scan_coverage(scans: DataFrame, series: DataFrame, by: list[str], scan_date: str, date: str, n: int, key: list[str]) -> DataFrame:
    """key, days, status of each scan: how many of its n days the series has."""
    days = scans.select(*key, *by, F.explode(F.sequence(F.date_sub(scan_date, n - 1), F.col(scan_date))).alias("_d"))
    hit = days.join(series.select(*by, F.col(date).alias("_d"), F.lit(1).alias("_h")).distinct(), [*by, "_d"], "left")
    out = hit.groupBy(*key).agg(F.count("_h").alias("days"))
    return out.withColumn("status", F.when(F.col("days") == n, "covered").when(F.col("days") > 0, "partial").otherwise("missing"))


def islands(rows: DataFrame, by: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """Runs of rows above a threshold that begin and end within the series: run, n_rows, peak."""
    o = Window.partitionBy(*by).orderBy(order)
    x = rows.withColumn("_n", F.row_number().over(o)).withColumn("_c", F.count("*").over(Window.partitionBy(*by)))
    high = x.where(F.col(value) > threshold).withColumn("_g", F.col("_n") - F.row_number().over(o))
    runs = high.groupBy(*by, "_g").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"), F.max("_c").alias("_c"), F.count("*").alias("n_rows"), F.max(value).alias("peak"))
    return runs.where((F.col("_a") > 1) & (F.col("_b") < F.col("_c"))).select(*by, (F.col("_a") - 1).cast("long").alias("first"), "n_rows", "peak")
