"""Closed syncmers against a plain version."""

import hashlib
import random
import re
import struct

import xxhash

from tidemark.llm import syncmers
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def hashed(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def closed(h):
    out = []
    for i in range(len(h) - 4):
        g = [hashed(a, b) for a, b in zip(h[i : i + 4], h[i + 1 : i + 5])]
        if min(g) in (g[0], g[3]):
            out.append(hashed(g[0], g[2], g[3]) & 0xFFFFFFFF)
    return out


def plain(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    out = closed([hashed(w) for w in words])
    if len(words) < 12:
        if 0 < len(text) < 5:
            return [hashed("t", text) & 0xFFFFFFFF]
        out += closed([hashed("c", c) for c in text])
    return out


def plain_rows(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashed(d[1] or "")))
    rows = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = plain(text), plain(edited), plain(after)
        like = lambda x, y: 1.0 if not set(x) | set(y) else 2 * len(set(x) & set(y)) / (len(set(x)) + len(set(y)))
        rows.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v:08X}" for v in a), "".join(f"{v:08X}" for v in b), like(a, b), like(a, c)))
    return sorted(rows, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()], key=str)


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op12_fingerprints"](spark, SF)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    rows = got(out)
    assert rows == plain_rows(docs)
    near = sorted(r[5] for r in rows)
    apart = sorted(r[6] for r in rows)
    assert near[len(near) // 20] > 0.3 and apart[len(apart) // 2] < 0.05


def test_odd_rows(documents, spark):
    rng = random.Random(5)
    words = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts = [None, "", "", "x", "abcd", " \n ", "𝒳é日本語 words", "é" * 9000, "a b c d e", "same words twice", "same words twice", *words]
    ids = [None, 9, 9, 8, 7, 7, None, 5, -4, 3, 3, *range(100, 160)]
    docs = documents(texts, ids)
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert got(syncmers.fingerprints(docs)) == plain_rows(list(zip(ids, texts)))
    assert got(syncmers.fingerprints(documents(["only one text here"], [4]))) == plain_rows([(4, "only one text here")])
    assert syncmers.fingerprints(docs.limit(0)).count() == 0


def test_equal_texts_and_clashing_names(spark):
    names = ["key", "number", "first", "range", "extra", "anchors", "next", "edited", "_w"]
    docs = spark.createDataFrame([(i, "one text of a few words " * 4) for i in range(50)] + [(7, "another")], "doc_id long, text string")
    docs = docs.selectExpr("*", *[f"'own' as {n}" for n in names])
    rows = syncmers.fingerprints(docs).collect()
    assert len(rows) == 51 and len({r["fingerprint"] for r in rows}) == 2


def test_long_text_is_linear(spark):
    import time

    took = []
    for n in (100_000, 400_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(n))), (2, "x")], "doc_id long, text string")
        start = time.time()
        assert len(syncmers.fingerprints(docs).where("doc_id = 1").first()["fingerprint"]) > n
        took.append(time.time() - start)
    assert took[1] < 12 * max(took[0], 0.5)
