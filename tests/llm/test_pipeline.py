"""The corpus pipeline, stage by stage, against plain versions on its own inputs."""

import corpus_pipeline as p
from test_duplicates import plain_components
from test_language_and_privacy import plain_leaks, plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, got = docs.columns, {r["doc_id"]: r for r in docs.collect()}, []
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        after = {r["doc_id"]: r for r in out.collect()}
        if name != "tokens":
            assert out.columns == columns and set(after) <= set(rows)
        if name == "language":
            assert len(after) >= 0.98 * len(rows)
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in plain_components([(i, r["text"]) for i, r in rows.items()], p.SHINGLE, p.PERCENT)}
        if name == "decontamination":
            assert set(rows) - set(after) == {d for d, _ in plain_leaks([(i, r["text"]) for i, r in rows.items()], bench)}
        if name == "personal_data":
            assert set(after) == set(rows) and not any(plain_spans(r["text"]) for r in after.values())
            assert all(r["text"] == rows[i]["text"] for i, r in after.items() if not plain_spans(rows[i]["text"]) and r["n_chars"] == rows[i]["n_chars"])
        if name == "tokens":
            assert set(after) == set(rows)
        got.append(len(after))
        docs, rows = spark.createDataFrame(list(after.values()), out.schema), after
    assert p.run(spark, SF).count() == got[-1]


def test_odd_tables(spark, tmp_path, sample):
    kind = "doc_id long, text string, lang string, source string, n_chars long, leak string, t1 int, near string"
    a, b = [t for t in sample if t and 100 < len(t.split()) < 500][:2]
    known = [(1000 + i, t, "en", "s", len(t), "own", 1, "x") for i, t in enumerate(sample[:60]) if t not in (a, b)]
    rows = [
        (1, a, "en", "s", 1, "own", 1, "x"), (2, a, None, None, None, "own", 1, "x"), (2, a, None, None, None, "own", 1, "x"), (2, b, "en", "s", 1, "own", 1, "x"), (3, None, None, None, None, "own", 1, "x"),
        (4, "", "en", "s", 0, "own", 1, "x"), (None, a + " and a tail", "en", "s", 1, "own", 1, "x"), (5, "12 34 !!", None, "s", 1, "own", 1, "x"), (6, (a + " ") * 40, "en", "s", 1, "own", 1, "x"),
    ]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, data in (("odd", known + rows), ("unlabelled", [(r[0], r[1], None, *r[3:]) for r in rows]), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, kind).repartition(2).write.parquet(f"{d}/documents.parquet")
        (bench if name == "odd" else bench.limit(0)).write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == [c.split()[0] for c in kind.split(", ")]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left = docs.collect()
        assert all((r["leak"], r["t1"], r["near"]) == ("own", 1, "x") for r in left)
        if name == "language":
            assert not {3, 4, 5} & {r["doc_id"] for r in left}
        if name == "near_duplicates":
            assert sum((r["text"] or "").startswith(a) and r["doc_id"] in (1, 2) for r in left) == 1
    out = p.run(spark, str(tmp_path / "odd"))
    assert out.count() == docs.count() > 0
    assert p.run(spark, str(tmp_path / "unlabelled")).count() == 0 == p.run(spark, str(tmp_path / "empty")).count()
