"""Jaccard components and repeated substrings against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tidemark.llm import jaccard, substrings
from tidemark.llm.graph import connected_components
from tidemark.llm.shingles import shingle_sets

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_components(rows, size, percent):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, plain_set(t, size)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def near_copies(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(120)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 8, 15, 40, 90]))] for _ in range(6)]
    texts = [None, "", " ", "a", "a b", "A B", "x\ty\nz", "x y z", "\xa0", "long " * 40_000]
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("size, percent, block", [(3, 90, 4096), (5, 80, 4), (2, 60, 7)])
def test_components(documents, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "SPAN_FIRST", 4)
    texts = near_copies(size)
    got = {tuple(r) for r in jaccard.jaccard_components(documents(texts), size, percent, block).collect()}
    assert got == plain_components(list(enumerate(texts)), size, percent)


def test_components_of_odd_tables(documents):
    assert jaccard.jaccard_components(documents([]), 3, 90).count() == 0
    rows = jaccard.jaccard_components(documents(["a b c d", "a b c d", "e f g h", "e f g h", "z"], [7, 7, 7, None, None]), 3, 90).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == {(7, 7): 3, (None, 7): 1, (None, None): 1}


def test_keep_first(documents):
    texts = near_copies(9, 60)
    docs = documents(texts)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    roots = {c for _, _, c in plain_components(list(enumerate(texts)), 5, 80)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(roots)
    twice = documents(["a b c d e f", "a b c d e f", None], [3, 3, None])
    assert sorted((r["doc_id"] is None, r["text"]) for r in jaccard.keep_first(twice).collect()) == [(False, "a b c d e f"), (True, None)]


def test_shingles_are_sets():
    a, b, c = shingle_sets(["The cat SAT the cat sat", "é x", ""], 3)
    assert len(a) == 3 and len(b) == 1 and len(c) == 0
    assert shingle_sets(["q w e r"], 2)[0].tolist() == shingle_sets(["zz", "q  W\te\nr"], 2)[1].tolist()


def test_graph(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)]
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {v: v for e in links for v in e}
    for _ in range(400):
        for a, b in links:
            m = min(parent[a], parent[b])
            parent[a] = parent[b] = m
    assert got == {v: p for v, p in parent.items() if any(v in e and e[0] != e[1] for e in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        step = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        gone = np.cumsum(step)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        out.append((len(r), int(gone.sum()), len(edges) // 2, sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def shared_passages(n=80):
    r = random.Random(6)
    base = ["".join(r.choice("abcdé ") for _ in range(300)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 200, "x" * 500, base[0], base[0]]
    for _ in range(n):
        t = ""
        for _ in range(r.randint(1, 5)):
            b, i = r.choice(base), r.randint(0, 250)
            t += b[i : i + r.randint(5, 120)] + "".join(r.choice("ab") for _ in range(r.randint(0, 8)))
        texts.append(t)
    return texts


@pytest.mark.parametrize("max_group, pairwise", [(100_000, 1000), (100_000, 2), (3, 1000)])
def test_repeated_bytes(documents, monkeypatch, max_group, pairwise):
    monkeypatch.setattr(substrings, "PAIRWISE", pairwise)
    texts = shared_passages()
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeated(documents(texts), 40, 12, max_group).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed(texts, 40)


def test_repeated_bytes_in_documents(documents, sample):
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeated(documents(sample)).collect()}
    assert [got[i] for i in range(len(sample))] == plain_removed(sample, 400)
    assert substrings.remove_repeated(documents([])).count() == 0


def test_kept_texts_and_removed_spans(documents):
    texts = [*shared_passages(30), "é" + "0123456789" * 5, "©" + "0123456789" * 5]  # both letters end in one byte
    rows = {r["doc_id"]: r for r in substrings.deduplicated(documents(texts), 40, 12).select("*", substrings.kept_text().alias("text")).collect()}
    cut = 0
    for i, (t, (n, gone, n_spans, _)) in enumerate(zip(texts, plain_removed(texts, 40))):
        raw, spans = (t or "").encode(), [(x["s"], x["e"]) for x in rows[i]["spans"]]
        assert (len(raw), sum(e - s for s, e in spans), len(spans)) == (n, gone, n_spans)
        ends = [0, *(x for span in spans for x in span), n]
        kept = b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2]))
        assert bytes(rows[i]["kept"]) == kept
        assert rows[i]["text"] == kept.decode("utf-8", "replace")
        cut += "\ufffd" in rows[i]["text"]
    assert cut


def test_query_gives_the_texts_that_remain(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    passage = " ".join(f"word{i} of the passage" for i in range(30))
    texts = [f"First beginning. {passage} First end.", f"Second beginning. {passage} Second end.", "A clean text.", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op9_substrings"](spark, str(tmp_path)).collect()}
    assert [got[i]["n_removed"] > 0 for i in range(4)] == [True, True, False, False]
    assert [got[i]["text"] for i in range(4)] == ["FirstFirst end.", "SecondSecond end.", "A clean text.", ""]


def test_deep_shallow_order():
    r = random.Random(7)
    for _ in range(60):
        size = r.choice([3, 9, 30])
        strings = [bytes(r.choice(b"ab") for _ in range(size)) for _ in range(r.randint(1, 40))]
        order, lcp = substrings.deep_shallow(strings, size, shallow=r.choice([0, 2, 8]))
        ranked = [strings[i] for i in order]
        assert ranked == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
        for a, b, n in zip(ranked, ranked[1:], lcp[1:]):
            assert n == next((k for k in range(size) if a[k] != b[k]), size)
