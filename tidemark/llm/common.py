"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: Spark's default of 10,000 whole texts would take hundreds of MB in a task.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master is local (as in tests) a folder of our own is made and set.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage at a copy that survives the loss of executors, and
    keeps column pruning for the readers that follow.  The shuffle files behind
    it are dropped as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def drop(written: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing will read again."""
    forget(written.sparkSession, written.scratch_path)


def split_by_bytes(values: list, limit: int):
    """Cut a list of strings into consecutive slices of about ``limit`` characters.

    Keeps the arrays that a task builds bounded, whatever the Arrow batch holds;
    a single longer text is a slice of its own.
    """
    start, held = 0, 0
    for i, value in enumerate(values):
        held += len(value)
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(values):
        yield slice(start, len(values))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bits that an id filter may have (32 MB), and bits an id.
FILTER_BITS, BITS_AN_ID = 1 << 28, 16


def likely_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids`` (one column), and a few others.

    A bitmap of hashed ids, made by one aggregation, lets the scan drop rows
    before a shuffle.  Its size is bounded; where the ids are too many for the
    bound, ``df`` comes back as it is.  An exact join must follow.
    """
    spark = df.sparkSession
    bits = 1 << (BITS_AN_ID * max(1, ids.count()) - 1).bit_length()
    if bits > FILTER_BITS:
        return df
    (name,) = ids.columns
    marks = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(name, F.lit(k)), F.lit(bits)) for k in (1, 2)])).alias("h"))
    words = marks.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(max(1, bits >> 6), np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def marked(a: pa.Array, b: pa.Array) -> pa.Array:
        m = shared.value
        places = [h.to_numpy(zero_copy_only=False) for h in (a, b)]
        return pa.array(np.logical_and.reduce([(m[h >> 6] >> (h & 63)) & 1 == 1 for h in places]))

    return df.where(marked(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in (1, 2)]))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        k = 0
        while f"_{name}{k}" in taken:
            k += 1
        out.append(f"_{name}{k}")
    return out


def whole_runs(batches, keys: list[str]):
    """From sorted Arrow batches, tables that end where a run of equal keys ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(held)
            held = []
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, b = [], b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)
