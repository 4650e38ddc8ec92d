"""Held-out accuracy of languages; personal data against plain patterns; leaks against counting every diagonal."""

import random
import re
from collections import Counter
from hashlib import sha256

import zlib

from tidemark.llm import decontam, langid, pii

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.language_of(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(not r["kept"] for r in rows) <= 0.01 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, documents):
    texts = [None, "", "12 !? 34", "a", "der die das und nicht " * 20_000] + ["the of and to in is that it"] * 20 + ["der die das und nicht ein zu"] * 20
    langs = [None, "en", "en", None, None] + ["en"] * 20 + ["de"] * 20
    docs = documents(texts, langs=langs)
    got = {r["doc_id"]: r for r in langid.language_of(docs).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[0]["score"] == 0 and got[4]["lang_pred"] == "de"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {0, 1, 2} & {r["doc_id"] for r in kept.collect()}
    assert langid.language_of(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.language_of(documents(["a b c", "d"])).collect()} == {"und"}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            out += [(m.start(), k, m.end(), kind)] if ok else []
    return sorted(out)


def test_base_spans(spark, documents, sample):
    r = random.Random(3)
    texts = ["".join(r.choice("0123456789  ..--+()@ab_%é🎉") for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += [None, "", "x@y.z_q@w.e", "a@b.c@d.e", "1" * 30_000, "a" * 60_000, "1.2.3.4.5.6.7.8 010.0255.1.1", "1 2 3 4 " * 5000, *sample, sample[0]]
    got = {x["doc_id"]: x for x in pii.personal_data(documents(texts)).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        listed = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert got[i]["base_sha256"] == sha256(",".join(listed).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert set(listed) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])


def test_added_spans_and_redaction(spark, documents):
    texts = ["a +1 (269) 555-3296 4524132264652876 b", "from 38.253.197.126 4880761348116108 on", "mail joe [at] foo [dot] com now", "we met at noon. It was at the shore.", "version 1.2.3 order 12345678", None]
    docs = documents(texts)
    got = {x["doc_id"]: x["spans"] for x in pii.personal_data(docs).collect()}
    assert got[0] == "phone:2:19,card:20:36" and got[1] == "ip:5:19,card:20:36" and got[2] == "email:5:27"
    assert got[3] == got[4] == got[5] == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert rows[0]["text"] == "a [PHONE] [CARD] b" and rows[0]["n_chars"] == 18 and rows[3]["text"] == texts[3] and rows[5]["text"] is None
    assert pii.personal_data(docs.limit(0)).count() == 0


def plain_leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held = {i: w for i, t in items if i is not None and len(w := words(t)) >= 5}
    at = {}
    for i, w in held.items():
        for q, x in enumerate(w):
            at.setdefault(x, []).append((i, q))
    out = set()
    for d, t in docs:
        diagonals = Counter((i, p - q) for p, x in enumerate(words(t)) for i, q in at.get(x, ()))
        out |= {(d, i) for (i, _), n in diagonals.items() if n >= 0.8 * len(held[i])}
    return out


def test_leaks(spark, documents, sample):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 40)))) for i in range(30)] + [(50, None), (None, "a b c d e f"), (51, ""), (52, "one two three four five")]
    items.append((53, items[7][1]))

    def planted(i):
        w = items[i][1].split()
        for k in range(4, len(w), 7):  # a substitution in every seven words
            w[k] = "other"
        return " ".join(r.choice(vocabulary) for _ in range(9)) + " " + ". ".join(w).title() + " " + " ".join(r.choice(vocabulary) for _ in range(9))

    texts = [planted(i) for i in range(30)] + [None, "", "One, two: three four FIVE!", items[9][1], items[9][1], " ".join(items[9][1].split()[3:]), *sample[:40]]
    docs, bench = documents(texts), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = plain_leaks(list(enumerate(texts)), items)
    assert len(want) > 20
    few = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert {x[:2] for x in few} == want and len(few) == len(want)
    assert sorted(map(tuple, decontam.leaks(docs, bench, max_words=10).collect())) == few
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_leaks_in_repetitive_texts(spark):
    import random
    import time

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["la", "la", "la", "lo"]) for _ in range(rng.randint(5, 40))) for _ in range(25)] + ["la " * 30, "la lo " * 12]
    items = ["la " * 8, "la lo la lo la lo", "lo la la la lo la", "la la la la la"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            h, w = t.split(), x.split()
            best = max((sum(0 <= s + k < len(h) and h[s + k] == w[k] for k in range(len(w))), -s) for s in range(1 - len(w), len(h)))
            if best[0] >= 0.8 * len(w):
                want[d, i] = (-best[1], best[0])
    for limit in (decontam.MAX_WORDS, 1):
        got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_match"]) for r in decontam.leaks(docs, bench, max_words=limit).collect()}
        assert got == want
    one, took = spark.createDataFrame([(1, "la " * 200)], "item_id long, text string"), []
    for n in (2000, 16_000):
        start = time.time()
        assert decontam.leaks(spark.createDataFrame([(1, "la " * n)], "doc_id long, text string"), one).first()["n_match"] == 200
        took.append(time.time() - start)
    assert took[1] < 8 * max(took[0], 2)
