"""Clustering and hard negatives against plain loops, on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import centroids, negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, tile int, n int, cluster string"


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, g, 1, 2, "own") for i, v, g in rows], SCHEMA).repartition(parts)


def floor(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, width):
    kept = [(i, floor(v, 256)) for i, v, _ in rows if fine(v) and len(v) == width]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda v: min((far(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        own = [choose(v)[1] for _, v in kept]
        middle = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else c for j, c in enumerate(middle)]
    found = [(i, *choose(v)[::-1]) for i, v in kept]
    total = {}
    for _, j, d in found:
        total[j] = total.get(j, 0) + d
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def odd_vectors(rng, n, width, low=-2, high=2):
    rows = [(i, [rng.randint(low * 256, high * 256) / 256 for _ in range(width)], rng.randint(0, 2)) for i in range(n)]
    rows += [(5, [0.25] * width, 1), (5, [0.25] * width, 1), (None, [0.5] * width, 0), (n, None, 1), (n + 1, [None] + [1.0] * (width - 1), 1), (n + 2, [math.nan] * width, 1), (n + 3, [math.inf] * width, 1)]
    rows += [(n + 4, [1.0] * (width + 1), 0), (n + 5, [], 0), (n + 6, [1.0] * width, None), (200, [2.0] * (width + 1), 0), (300, [3.0] * (width + 1), 1)]
    return rows + [(1000 + i, rows[3][1], 1) for i in range(n // 3)]  # a hot group of copies


@pytest.mark.parametrize("width,k,low", [(1, 3, -2), (2, 7, -1), (6, 12, 0)])
def test_clusters(spark, width, k, low):
    rows = odd_vectors(random.Random(width), 90, width, low, 2)
    got = centroids.cluster(table_of(spark, rows), clusters=k, rounds=4, width=width).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, k, 4, width)


def test_few_clusters_and_limits(spark):
    rows = [(i, [float(i)], 0) for i in range(3)]
    assert len(centroids.cluster(table_of(spark, rows), width=1).collect()) == 3
    assert centroids.cluster(table_of(spark, rows)).collect() == [] == centroids.cluster(table_of(spark, rows).limit(0), width=1).collect()
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(table_of(spark, [*rows, (9, [1e9], 0)]), width=1).collect()


def test_trees_prune_and_agree():
    rng = np.random.default_rng(3)
    middle = rng.integers(-4000, 4000, (40, 8))
    points = (middle[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int64)
    tree, small = centroids.CoverTree.build(points), centroids.CoverTree.build(middle, leaf=1)
    assert (np.sort(tree.order) == np.arange(2000)).all()
    for at in range(len(tree.radius)):
        own = tree.points[tree.start[at] : tree.end[at]]
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= tree.radius[at]
        if tree.kids[at]:
            kids = range(tree.kid[at], tree.kid[at] + tree.kids[at])
            assert [tree.start[kids[0]], tree.end[kids[-1]]] == [tree.start[at], tree.end[at]] and all(tree.radius[j] < tree.radius[at] for j in kids)
    seen = []
    apart = centroids._apart
    try:
        centroids._apart = lambda x, y: seen.append(len(x)) or apart(x, y)
        own = centroids.nearest(tree, small)
    finally:
        centroids._apart = apart
    assert (own == ((tree.points[:, None] - middle[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < 2000 * 40 / 4  # node pairs


def plain_negatives(rows, step, k, percent):
    kept = [(n, i, g, floor(v, 256)) for n, (i, v, g) in enumerate(rows) if fine(v) and i is not None and g is not None]
    out = []
    for n, i, g, v in kept:
        if i % step:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, h) for m, j, h, w in kept if m != n and len(w) == len(v))
        for s, p, _ in [o for o in others if o[2] == g][:k]:
            hard = [(j, -t) for t, j, h in others if h != g and percent * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("width,parts", [(1, 1), (4, 5), (9, 2)])
def test_negatives(spark, width, parts):
    rows = odd_vectors(random.Random(width), 160, width)
    got = negatives.hard_negatives(table_of(spark, rows, parts), anchor_step=5, k=3).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 5, 3, 80)


def test_negatives_skip_vectors_by_bounds(monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 64)) + 4 * rng.normal(size=(10, 64))[np.arange(2000) % 10]
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    order = np.argsort(np.arange(2000) % 10, kind="stable")
    v, groups = v[order], (np.arange(2000) % 10)[order]
    tile = {"tile": 0, "n": 2000, "width": 64, "ids": order.tolist(), "groups": groups.tolist(), "body": vectors.body_of(v)} | negatives._cell_columns(None, None, v)
    opened, scored = negatives.Approximated(tile), []
    for q in v[:50]:
        low, gap = opened.bounds(q, slice(0, 2000))
        exact = v @ q
        assert (low <= exact).all() and (exact <= low + gap).all()
        scored.append(len(negatives.candidates(low, gap, negatives.Best(5), negatives.NONE // 4, negatives.ALL)))
    assert max(scored) < 400


def test_no_anchor_and_no_rows(spark):
    rows = [(1, [1.0], 0), (2, [1.0], 1)]
    assert negatives.hard_negatives(table_of(spark, rows)).collect() == [] == negatives.hard_negatives(table_of(spark, rows).limit(0)).collect()
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(table_of(spark, [(0, [1e9], 0), (100, [1e9], 0)])).collect()
