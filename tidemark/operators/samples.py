"""Event aggregation and training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lab


def aggregate_events(events: DataFrame, by: list[str]) -> DataFrame:
    """Events of one cell: summed volume and width, root of summed squared uncertainty, mean elevation, greatest height, class of the sum."""
    out = events.groupBy(*by).agg(
        F.sum("volume").alias("volume"), F.sqrt(F.sum(F.col("vol_unc") * F.col("vol_unc"))).alias("vol_unc"), F.avg("elevation").alias("elevation"),
        F.sum("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("n_events"),
    )
    return out.withColumn("event_class", lab.volume_class(F.col("volume")))


def label_cells(cells: DataFrame, events: DataFrame, height: str, by: str = "transect_idx", epoch: str = "epoch_idx") -> DataFrame:
    """Cells with their events (``history.events_by_cell``); without one volume 0, class 0 and risk of none.

    The cliff's height in the risk is that of the transect's latest earlier cell, 15 without one.
    """
    before = F.lag(height).over(Window.partitionBy(by).orderBy(epoch))
    x = cells.withColumn("_h", F.coalesce(before.cast("double"), F.lit(15.0))).join(events, [by, epoch], "left")
    v = F.coalesce("volume", F.lit(0.0))
    return x.select(*cells.columns, v.alias("volume"), F.coalesce("event_class", F.lit(0)).alias("event_class"), F.col("_h").alias("height"), lab.risk_index(v, F.col("_h")).alias("risk"), lab.collapse_labels(v).alias("collapse"))


def context(cells: DataFrame, by: list[str], order: str, value: str, most: int = 10, least: int = 3) -> DataFrame:
    """Each cell with up to ``most`` earlier values, padded in front with nulls, and how many there are; cells with fewer than ``least`` go."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-most, -1)
    x = cells.withColumn("_c", F.collect_list(F.struct(F.col(value).alias("v"))).over(w)).withColumn("n_context", F.size("_c"))
    padded = F.concat(F.array_repeat(F.lit(None).cast(cells.schema[value].dataType), F.lit(most) - F.col("n_context")), F.transform("_c", lambda s: s["v"]))
    return x.withColumn("context", padded).drop("_c").where(F.col("n_context") >= least)


def chronological_split(rows: DataFrame, date: str, key: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Append split: the first int(n * train) rows by date and key, the next int(n * validation), the rest.

    A row's rank is the number of rows of earlier dates and its rank on its own
    date, so only one date's rows are ranked together.
    """
    days = rows.groupBy(date).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1))  # a row a date
    places = days.select(date, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(date).orderBy(key))
    first, second = F.floor(F.col("_all") * train), F.floor(F.col("_all") * validation)
    split = F.when(rank <= first, "train").when(rank <= first + second, "validation").otherwise("test")
    return rows.join(places, date).select(*rows.columns, split.alias("split"))


def hashed_split(rows: DataFrame, key: str, seed: int = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Append a split that depends on the key and seed alone."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def subsample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement, the same on every run."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def queue(events: DataFrame, key: list[str], limit: int = 2000) -> DataFrame:
    """The largest event of each key, largest first, numbered; at most ``limit``."""
    best = events.groupBy(*key).agg(F.max_by(F.struct(*events.columns), F.struct("volume", -F.col("event_id"))).alias("_e")).select("_e.*")
    top = best.orderBy(F.desc("volume"), "event_id").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("volume"), "event_id")))
