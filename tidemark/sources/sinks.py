"""Writers."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npz

#: Rows that a single NPZ file may hold: it passes through the driver.
NPZ_ROWS = 1_000_000


def write_by(df: DataFrame, path: str, by: str) -> None:
    """Parquet, a directory for each value; a large value is written by several tasks."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_npz(df: DataFrame, path: str, rows: int = 500_000) -> None:
    """A table of any size as NPZ archives of at most ``rows`` rows, a column an array, written by the tasks themselves.

    ``path/manifest.json`` names the archives that count, with their rows; it is
    written when all tasks have ended, so the files of a lost or repeated task
    are never read as data.
    """
    df.sparkSession.dataSource.register(npz.NpzSink)
    df.write.format("npz").mode("append").option("rows", rows).save(path)


def to_npz(df: DataFrame) -> bytes:
    """A small table as one NPZ file, a column an array; refuses more than NPZ_ROWS rows, for which ``write_npz`` is."""
    table = df.limit(NPZ_ROWS + 1).toPandas()
    if len(table) > NPZ_ROWS:
        raise ValueError(f"an NPZ export holds at most {NPZ_ROWS} rows")
    out = io.BytesIO()
    np.savez_compressed(out, **{c: np.stack(table[c].to_numpy()) if len(table) and hasattr(table[c].iloc[0], "__len__") and not isinstance(table[c].iloc[0], str) else table[c].to_numpy().astype("U" if table[c].dtype == object else table[c].dtype) for c in table.columns})
    return out.getvalue()


def report_lines(checks: DataFrame) -> DataFrame:
    """A quality report (check, severity, message) as text lines, errors first."""
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return checks.orderBy(order, "check").select(F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "check", F.lit(": "), "message").alias("value"))
