"""Labels of (transect, pair) cells as a partitioned table of which an edit rewrites only what it touches.

    store/labels/bucket=N/   transect_idx, pair, label, version
    store/log/               a row a save: n_rows, labeler, saved_at

A label of -1 is none.  Every row has a version, which a save raises; an edit
names the version that it has seen, and one that is no longer current is
refused, so no one's label is overwritten unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, BUCKETS = -1, 64
KEY = ["transect_idx", "pair"]


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("transect_idx"), F.lit(buckets)).cast("int"))


def empty_labels(transects: DataFrame, epochs: DataFrame) -> DataFrame:
    """transect_idx, pair, label: every transect at every pair of neighbouring epochs, without a label."""
    pairs = epochs.agg(F.greatest(F.count("*") - 2, F.lit(-1)).alias("_n"))  # one row
    grid = transects.select("transect_idx").join(F.broadcast(pairs))
    return grid.withColumn("pair", F.explode(F.filter(F.sequence(F.lit(0), F.greatest("_n", F.lit(0))), lambda p: p <= F.col("_n")))).select("transect_idx", F.col("pair").cast("int"), F.lit(NONE).alias("label"))


def create(labels: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a new store from transect_idx, pair and label."""
    rows = _bucketed(labels.select(*KEY, F.col("label").cast("int").alias("label"), F.lit(0).cast("long").alias("version")), buckets)
    rows.repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/labels")
    labels.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def load(spark: SparkSession, path: str) -> DataFrame:
    """transect_idx, pair, label, version."""
    return spark.read.parquet(f"{path}/labels").select(*KEY, "label", "version")


class Conflict(ValueError):
    """An edit that can't be saved: of a cell that isn't there, given twice, or seen in an older version."""


def save(edits: DataFrame, path: str, labeler: str = "") -> int:
    """Save edits (transect_idx, pair, label, version seen); only the buckets they lie in are rewritten.

    Returns how many rows changed.  Nothing is written where any edit conflicts.
    """
    spark = edits.sparkSession
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    new = _bucketed(edits.select(*KEY, F.col("label").cast("int").alias("_label"), F.col("version").alias("_seen")), buckets)
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return 0
    stored = spark.read.parquet(f"{path}/labels").where(F.col("bucket").isin(touched))
    both = new.join(stored, [*KEY, "bucket"], "left")
    bad = both.agg(
        F.count_if(F.col("version").isNull()).alias("unknown"), F.count_if(F.col("version") != F.col("_seen")).alias("old"), (F.count("*") - F.count_distinct(*KEY)).alias("twice"), F.count("*").alias("n")
    ).first()
    if bad["unknown"] or bad["old"] or bad["twice"]:
        raise Conflict(f"{bad['unknown']} edits of no cell, {bad['old']} of an older version, {bad['twice']} repeated")
    merged = stored.join(new, [*KEY, "bucket"], "left").select(
        *KEY, F.coalesce("_label", "label").alias("label"), (F.col("version") + F.col("_label").isNotNull().cast("long")).alias("version"), "bucket"
    )
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/labels")
    log = spark.range(1).select(F.lit(bad["n"]).cast("long").alias("n_rows"), F.lit(labeler).alias("labeler"), F.current_timestamp().alias("saved_at"))
    log.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return bad["n"]


def compatibility(labels: DataFrame, transects: DataFrame, epochs: DataFrame) -> list[str]:
    """What is wrong between labels and the data they are of; empty where nothing is."""
    n = labels.agg(F.count_distinct("transect_idx").alias("t"), F.count_distinct("pair").alias("p")).first()
    t, p = transects.count(), max(0, epochs.count() - 1)
    errors = [] if n["t"] == t else [f"Transect count mismatch: data={t}, labels={n['t']}"]
    return errors + ([] if n["p"] == p else [f"Pair count mismatch: expected={p}, labels={n['p']}"])


def summary(labels: DataFrame, classes: int = 5) -> DataFrame:
    """One row: n_labeled, n_unlabeled and the count of each class."""
    count = lambda i: F.count_if(F.col("label") == i)
    return labels.agg(F.count_if(F.col("label") != NONE).alias("n_labeled"), count(NONE).alias("n_unlabeled"), F.array(*[count(i) for i in range(classes)]).alias("label_counts"))
