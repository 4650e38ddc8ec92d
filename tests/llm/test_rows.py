"""Rows of one doc_id, extra columns with the operators' own names, and both sides of size switches."""

import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, jaccard, langid, pii

NAMES = ["_one0", "_two0", "_id0", "_base0", "_spans0", "_clean0", "_lang0", "leak", "t1", "t2", "component", "print", "h", "near", "lang_kept"]
A, B = "one two three four five six seven", "other words that share nothing with the first text"


def named(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").repartition(2)
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def own(rows):
    return all(r[n] == f"own {n}" for r in rows for n in NAMES)


def test_filters_judge_rows_and_keep_columns(spark):
    docs = named(spark, [(1, A, "en", 9), (1, B, "en", 9), (1, B, "en", 9), (2, A + " eight", "en", 9), (None, A, "en", 9), (None, None, None, None)])
    kept = jaccard.keep_first(docs, 5, 60)
    rows = kept.collect()
    assert kept.columns == docs.columns and own(rows)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == [(0, ""), (1, A), (1, B)]
    bench = spark.createDataFrame([(7, A)], "item_id long, text string")
    for limit in (decontam.MAX_WORDS, 1):
        clean = decontam.decontaminate(docs, bench, max_words=limit)
        rows = clean.collect()
        assert clean.columns == docs.columns and own(rows)
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == [(0, ""), (1, B), (1, B)]
    for out in (langid.keep_identified(docs), pii.redact(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and own(rows) and len(rows) >= 5


def test_long_items_are_found(spark):
    words = [f"w{i}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, " ".join(words[:5000]))], "doc_id long, text string")
    found = decontam.leaks(docs, spark.createDataFrame([(3, " ".join(words))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["n_match"]) for r in found] == [(1, 3, 1, 50_000)]


def test_many_spans_are_placed_in_linear_time(spark):
    text = " ".join(f"a{i}@example.org 10.0.{i % 256}.{i % 99}" for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.models(spark)
    start = time.time()
    row = pii.personal_data(docs).first()
    assert row["n_email"] == row["n_ip"] == 4000 and time.time() - start < 60
    assert pii.redact(docs).first()["text"] == " ".join(["[EMAIL] [IP]"] * 4000)
    assert row["spans"].split(",")[0] == "email:0:14" and len(re.findall(",", row["spans"])) == 7999


def test_id_filter_changes_no_result(spark, monkeypatch):
    rows, ids = spark.range(3000).withColumnRenamed("id", "k"), spark.range(0, 3000, 7)
    for bits in (common.FILTER_BITS, 1):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        left = common.likely_in(rows, "k", ids)
        assert left.join(ids.withColumnRenamed("id", "k"), "k").count() == ids.count() and (left.count() < 1000) == (bits > 1)


def test_whole_runs():
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.record_batch({"k": pa.array(keys[a:b], pa.int64())}) for a, b in ((0, 3), (3, 3), (3, 5), (5, 7), (7, 10))]
    runs = [t.column("k").to_pylist() for t in common.whole_runs(batches, ["k"])]
    assert sum(runs, []) == keys and all(a[-1] != b[0] for a, b in zip(runs, runs[1:]))
