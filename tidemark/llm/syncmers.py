"""Document fingerprints of closed syncmers, with DataFrame functions only.

A text is a sequence of words.  Of the ``K`` words at each place the pairs of
neighbours are hashed; where the least of these ``K - 1`` hashes stands first or
last the ``K`` words are a closed syncmer, and their hash is an anchor.  Whether
words are one depends on those words alone, so equal passages give equal
anchors wherever they stand, and a change touches only the anchors it lies in.
The fingerprint is the anchors in the order of the text, eight hex digits each;
the likeness of two fingerprints is 2 * shared / (own + own) over their
different anchors.  Texts of fewer than ``SHORT`` words add the anchors of their
characters, by the same rule; a text of fewer than ``K`` characters has itself
as its anchor, an empty one has none.

The successor of a document is found without ordering the table in one place:
keys are cut into ranges, rows are dealt by range, and the first row of a range
also goes to the range before it (that of the first range to the last), so each
range has the successors of its own rows.

Results for unusual input: a null text counts as empty; two empty fingerprints
have likeness 1, an empty and another 0; null ids come last; rows of one id
follow each other by a hash of their text, and copies of a row by one another
(they are sorted in one task, never gathered); a lone document is its own
successor; an empty table gives an empty result; extra columns are ignored.
A text's words are one array of a row, so texts are bounded by a task's memory.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

K, SHORT, SPACE = 5, 12, "[ \\t\\n\\x0B\\f\\r]+"
#: Ranges of ids for each shuffle partition: more ranges are dealt more evenly.
RANGES = 3


def _pairs(h: Column) -> Column:
    return F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _closed(g: Column, n: Column) -> Column:
    """Anchors of the places whose least pair hash is the first or the last one."""
    at = lambda i, j: F.get(g, i + F.lit(j))
    middle = [lambda i, j=j: at(i, j) for j in range(1, K - 2)]
    value = lambda i: F.xxhash64(*[at(i, j) for j in (*range(0, K - 2, 2), K - 2)]).bitwiseAND(F.lit(0xFFFFFFFF))
    picked = F.transform(
        F.sequence(F.lit(0), n - F.lit(K)),
        lambda i: F.when(F.least(at(i, 0), at(i, K - 2)) <= F.least(*[m(i) for m in middle]), value(i)),
    )
    return F.when(n >= K, F.array_compact(picked)).otherwise(F.array().cast("array<bigint>"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """The table with the anchors of a text column: array<long>, in the order of the text.

    Each step is a column of its own, so nothing is computed twice for a place.
    """
    t = F.col(text)
    own = df.columns
    a = df.withColumn("_w", F.array_remove(F.split(t, SPACE), "")).withColumn("_n", F.size("_w"))
    a = a.withColumn("_c", F.when(F.col("_n") < SHORT, F.array_remove(F.split(t, ""), "")).otherwise(F.array().cast("array<string>")))
    a = a.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_d", F.transform("_c", lambda w: F.xxhash64(F.lit("c"), w)))
    a = a.withColumn("_g", _pairs(F.col("_h"))).withColumn("_e", _pairs(F.col("_d"))).withColumn("_m", F.size("_c"))
    a = a.withColumn("_x", _closed(F.col("_g"), F.col("_n"))).withColumn("_y", _closed(F.col("_e"), F.col("_m")))
    whole = F.array(F.xxhash64(F.lit("t"), t).bitwiseAND(F.lit(0xFFFFFFFF)))
    found = F.when(F.col("_n") >= SHORT, F.col("_x")).when(F.col("_m") >= K, F.concat("_x", "_y")).when(t == "", F.array().cast("array<bigint>")).otherwise(whole)
    return a.select(*own, found.alias(out))


def as_text(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.lit(2.0) * shared / (shared + either))


KEY = "struct<empty:int,place:bigint,text:bigint>"


def _ranged(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, key, range, extra): extra rows only serve as the successor of the range's last row."""
    spark = docs.sparkSession
    text = text_or_empty()
    i = F.col("doc_id").cast("long")
    # ~id falls as the id rises
    key = F.struct(i.isNull().cast("int").alias("empty"), F.coalesce(F.bitwise_not(i), F.lit(0)).cast("long").alias("place"), F.xxhash64(text).alias("text"))
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    bounds = sorted({tuple(r["key"]) for r in least.select("key").collect()})  # a row a range
    listed = F.from_json(F.lit(json.dumps([dict(zip(("empty", "place", "text"), b)) for b in bounds])), f"array<{KEY}>")
    steps = [1 << b for b in range(len(bounds).bit_length(), -1, -1)]
    number = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when(F.get(listed, low + s - F.lit(1)) <= F.col("key"), low + s).otherwise(low)
    )  # how many bounds are not above the key
    rows = rows.withColumn("number", F.greatest(number - F.lit(1), F.lit(0)))
    rows = rows.withColumn("first", F.get(listed, F.col("number")) == F.col("key"))
    last = max(0, len(bounds) - 1)
    before = F.when(F.col("number") == 0, F.lit(last)).otherwise(F.col("number") - F.lit(1))
    here, there = F.struct(F.col("number").alias("range"), F.lit(0).alias("extra")), F.struct(before.alias("range"), F.lit(1).alias("extra"))
    return rows.withColumn("goes", F.explode(F.when(F.col("first"), F.array(here, there)).otherwise(F.array(here)))).select("doc_id", "text", "key", "goes.range", "goes.extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by the start of the next document
    by falling doc_id.
    """
    dealt = with_anchors(_ranged(docs).repartition("range"), "text", "anchors")
    order = Window.partitionBy("range").orderBy("extra", "key")
    follows = dealt.withColumn("next", F.lead("text").over(order)).withColumn("next_anchors", F.lead("anchors").over(order)).where(F.col("extra") == 0)
    n = F.length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    following = F.coalesce("next", F.raise_error(F.lit("a document without a successor")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(following, F.lit(1), third))
    rows = follows.select("doc_id", n.cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    rows = with_anchors(rows, "edited", "edited_anchors")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text("anchors").alias("fingerprint"), as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"), likeness("anchors", "next_anchors").alias("near_next"),
    )
