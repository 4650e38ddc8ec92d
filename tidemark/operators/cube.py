"""The transect x epoch cube as a sparse fact table with its dimensions: placement, slices, coverage, change, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_dimension(surveys: DataFrame, name: str, date: str) -> DataFrame:
    """epoch_idx by date, then name; surveys without a date come first, on 1970-01-01.

    A dimension of survey dates: its one window is over its own few rows.
    """
    d = surveys.select(F.col(name).alias("epoch_name"), F.coalesce(F.col(date), F.lit("1970-01-01").cast("date")).alias("epoch_date")).distinct()
    return d.withColumn("epoch_idx", (F.row_number().over(Window.orderBy("epoch_date", "epoch_name")) - 1).cast("int"))


def place(rows: DataFrame, transects: DataFrame, epochs: DataFrame, transect: str, epoch: str, order: list[str]) -> DataFrame:
    """Cells of the cube: of rows for one cell the last by ``order``; rows that name no transect or epoch go."""
    from .joins import keep_last

    known = rows.join(transects, transect).join(epochs, epoch)
    return keep_last(known, ["transect_idx", "epoch_idx"], order)


def unmatched(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key the dimension doesn't hold."""
    return rows.join(dim.select(key).distinct(), key, "left_anti")


def dense(cells: DataFrame, transects: DataFrame, epochs: DataFrame) -> DataFrame:
    """Every transect at every epoch, present or not (the two dimensions' product, by an exploded list of epochs)."""
    listed = epochs.agg(F.collect_list("epoch_idx").alias("_e"))  # one short row
    grid = transects.join(F.broadcast(listed)).withColumn("epoch_idx", F.explode("_e")).drop("_e")
    return grid.join(cells.withColumn("present", F.lit(True)), ["transect_idx", "epoch_idx"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def coverage(cells: DataFrame, n_transects: int, n_epochs: int) -> DataFrame:
    """Present cells and their share: in all, by epoch and by transect (grouping sets)."""
    c = cells.select("transect_idx", "epoch_idx").distinct()
    out = c.groupingSets([("epoch_idx",), ("transect_idx",), ()], "epoch_idx", "transect_idx").agg(F.count("*").alias("present"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 1, "epoch").when(F.col("gid") == 2, "transect").otherwise("all")
    total = F.when(F.col("gid") == 1, n_transects).when(F.col("gid") == 2, n_epochs).otherwise(n_transects * n_epochs)
    return out.select(
        level.alias("level"), F.coalesce("epoch_idx", "transect_idx").alias("idx"), "present", (total - F.col("present")).cast("long").alias("missing"),
        F.round(100.0 * F.col("present") / total, 6).alias("pct"), (F.col("present") == total).alias("is_full"),
    )


def low_coverage(cells: DataFrame, least: int) -> DataFrame:
    """Epochs with some cells but fewer than ``least``; epochs without any aren't listed."""
    return cells.groupBy("epoch_idx").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") < least)


def change(points: DataFrame, by: list[str], first: int, second: int, z: str = "elevation") -> DataFrame:
    """Differences between two epochs at equal point indices: mean, greatest, least, standard deviation, gain and loss."""
    a = points.where(F.col("epoch_idx") == first).select(*by, "i", F.col(z).alias("_a"))
    b = points.where(F.col("epoch_idx") == second).select(*by, "i", F.col(z).alias("_b"))
    d = a.join(b, [*by, "i"]).withColumn("_d", F.col("_b") - F.col("_a"))
    return d.groupBy(*by).agg(
        F.avg("_d").alias("mean"), F.max("_d").alias("max"), F.min("_d").alias("min"), F.stddev_pop("_d").alias("std"),
        F.sum(F.when(F.col("_d") >= 0, F.col("_d")).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("_d") < 0, F.col("_d")).otherwise(0.0)).alias("loss"),
    )


def epoch_slice(cells: DataFrame, epochs: DataFrame, i: int) -> DataFrame:
    """The cells of one epoch by its place in date order; negative ones count from the end."""
    listed = [r["epoch_idx"] for r in epochs.select("epoch_idx", "epoch_date").orderBy("epoch_date", "epoch_idx").collect()]  # a row a survey
    if not -len(listed) <= i < len(listed):
        raise IndexError(f"epoch {i} of {len(listed)}")
    return cells.where(F.col("epoch_idx") == listed[i])


def feature_over_time(points: DataFrame, by: list[str], epoch: str, feature: str) -> DataFrame:
    """by, epoch, feature: one feature of every point, by epoch."""
    if feature not in points.columns:
        raise KeyError(f"no feature {feature}; there are {', '.join(c for c in points.columns if c not in (*by, epoch))}")
    return points.select(*by, epoch, feature)


def successive_pairs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Each cell with the next covered epoch of its transect: pair (epoch_before, epoch_after)."""
    w = Window.partitionBy(*by).orderBy("epoch_idx")
    return cells.select(*by, F.col("epoch_idx").alias("epoch_before"), F.lead("epoch_idx").over(w).alias("epoch_after")).where("epoch_after is not null")


def reference_cell(cells: DataFrame, by: list[str], toe: str, top: str, min_width: float = 5.0) -> DataFrame:
    """The first epoch of each transect whose cliff is wide enough."""
    wide = cells.where(F.col(top) - F.col(toe) >= min_width)
    return wide.groupBy(*by).agg(F.min_by(F.struct(F.col("epoch_idx").alias("epoch_ref"), F.col(toe).alias("toe_ref"), F.col(top).alias("top_ref")), "epoch_idx").alias("_r")).select(*by, "_r.*")


def window_choice(cells: DataFrame, reference: DataFrame, by: list[str], toe: str, top: str, fallback: tuple[float, float] | None, min_width: float = 5.0) -> DataFrame:
    """The crop window of each cell: the reference's, else its own cliff's, else the fallback; cells with none go."""
    x = cells.join(reference, by, "left")
    own = F.col(top) - F.col(toe) >= min_width
    source = F.when(F.col("epoch_ref").isNotNull(), "reference").when(own, "own")
    lo, hi = F.when(F.col("epoch_ref").isNotNull(), F.col("toe_ref")).when(own, F.col(toe)), F.when(F.col("epoch_ref").isNotNull(), F.col("top_ref")).when(own, F.col(top))
    if fallback:
        source, lo, hi = source.otherwise("fallback"), lo.otherwise(fallback[0]), hi.otherwise(fallback[1])
    return x.withColumn("window", source).withColumn("lo", lo).withColumn("hi", hi).where("window is not null").drop("epoch_ref", "toe_ref", "top_ref")


def label_progress(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    """Cells, labelled cells and their share."""
    return labels.groupBy(*by).agg(F.count("*").alias("total"), F.count(label).alias("labeled")).withColumn("pct", F.round(100.0 * F.col("labeled") / F.col("total"), 6))


def upsert(table: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """A table with the edits' rows in place of its own."""
    return table.join(edits.select(*key), key, "left_anti").unionByName(edits)
