"""Exact top-k inner products by three-phase uniform thresholds.

The dimensions are cut into ``BLOCKS`` nodes, so a score is a sum of one partial
score a node.  Queries meet the vectors in blocks: a block of queries with every
part of the tiles, a key each, so no key holds more than a block and a part.

1. Every node lists its highest partial scores in a tile.  The k best full
   scores among the listed candidates, and the greatest partial score of any
   node for each query and tile, are kept.
2. The k-th best of a query over all parts can't be above its true k-th score:
   it is a safe cutoff.  A candidate that reaches it has a partial score of
   cutoff / BLOCKS or more at some node, so a tile whose greatest partial score
   is below that is not opened for the query again; of the others each node
   collects just those entries.
3. The collected candidates' missing partial scores are added up exactly, and
   the best k are kept, ties to the smaller id.

Results for unusual input: null vectors, null ids, and vectors with null or
non-finite components take no part; vectors are compared with those of their own
length (the product of two empty ones is 0); every row whose id is divisible by
the step is a query of its own, and all other rows are its candidates, those of
its own id included; fewer than k candidates give them all; an empty table gives
an empty result; extra columns are ignored.  Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import blocks_and_tiles, check_products, first_by_score, integer_vectors, members, open_body, tiles_of

K, QUERY_STEP, SCALE, BLOCKS = 10, 100, 1024.0, 4
NONE = np.iinfo(np.int64).min

_LISTS = "q_tile long, q_place int, query_id long, part int, vec_id long, score long, tiles array<long>, tops array<long>"
_FOUND = "q_tile long, q_place int, query_id long, vec_id long, score long"


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; through doubles where those are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _queries(left: pa.Table) -> tuple[dict, np.ndarray]:
    rows = left.to_pydict()
    width = rows["width"][0] if rows["width"] else 0
    return rows, np.array([open_body(b, 1, width)[0] for b in rows["q_body"]], np.int64).reshape(left.num_rows, width)


def _tiles(right: pa.Table):
    for i in range(right.num_rows):
        (t,) = right.slice(i, 1).to_pylist()
        yield t["tile"], np.array(t["ids"], np.int64), open_body(t["body"], t["n"], t["width"]).astype(np.int64)


def _nodes(width: int, blocks: int) -> list[np.ndarray]:
    return [n for n in np.array_split(np.arange(width), blocks) if len(n)] or [np.arange(0)]


def _hide_own(listed: np.ndarray, rows: dict, alive: np.ndarray, tile: int) -> None:
    for at, r in enumerate(alive):
        if rows["q_tile"][r] == tile:
            listed[at, rows["q_place"][r]] = False


def local_lists(left: pa.Table, right: pa.Table, k: int, blocks: int) -> pa.Table:
    """Phase 1 of a block of queries and a part of the tiles."""
    rows, q = _queries(left)
    if not left.num_rows:  # tiles of a length that no query has
        return _schema(_LISTS).empty_table()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    names, tops = [], []
    everyone = np.arange(len(q))
    for tile, ids, c in _tiles(right):
        check_products(q, c)
        listed, top = np.zeros((len(q), len(ids)), bool), np.full(len(q), NONE)
        for node in _nodes(q.shape[1], blocks):
            partial = _exact(q[:, node], c[:, node])
            n = min(len(ids), k + 1)
            near = np.argpartition(-partial, n - 1, axis=1)[:, :n]
            np.put_along_axis(listed, near, True, axis=1)
            top = np.maximum(top, partial.max(axis=1))
        _hide_own(listed, rows, everyone, tile)
        names.append(tile)
        tops.append(top)
        for r in everyone:
            own = np.flatnonzero(listed[r])
            score, found = np.concatenate([best[r][0], c[own] @ q[r]]), np.concatenate([best[r][1], ids[own]])
            first = first_by_score(score, found, k)
            best[r] = score[first], found[first]
    part = rows["part"][0]
    out = {n: [] for n in ("q_tile", "q_place", "query_id", "part", "vec_id", "score", "tiles", "tops")}

    def add(r, vec_id, score, tiles=None, top=None):
        for n, v in zip(out, (rows["q_tile"][r], rows["q_place"][r], rows["q_id"][r], part, vec_id, score, tiles, top)):
            out[n].append(v)

    for r in everyone:
        add(r, None, None, names, [int(t[r]) for t in tops])
        for score, vec_id in zip(*best[r]):
            add(r, int(vec_id), int(score))
    return pa.table(out, schema=_schema(_LISTS))


def collected(left: pa.Table, right: pa.Table, k: int, blocks: int) -> pa.Table:
    """Phases 2 and 3: entries that reach a query's share of its cutoff, with exact scores."""
    rows, q = _queries(left)
    if not left.num_rows:
        return _schema(_FOUND).empty_table()
    cut = np.array([NONE if c is None else c for c in rows["cut"]], np.int64)
    share = np.where(cut == NONE, NONE, -(-cut // blocks))  # integer partial scores: one reaches the ceiling of the mean
    known = [dict(zip(t or [], p or [])) for t, p in zip(rows["tiles"], rows["tops"])]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    for tile, ids, c in _tiles(right):
        alive = np.array([r for r in range(len(q)) if known[r].get(tile, share[r]) >= share[r]], np.int64)
        if not len(alive):
            continue
        hit = np.zeros((len(alive), len(ids)), bool)
        for node in _nodes(q.shape[1], blocks):
            hit |= _exact(q[alive][:, node], c[:, node]) >= share[alive][:, None]
        _hide_own(hit, rows, alive, tile)
        for at in np.flatnonzero(hit.any(axis=1)):
            r, own = alive[at], np.flatnonzero(hit[at])
            score = c[own] @ q[r]
            own, score = own[score >= cut[r]], score[score >= cut[r]]
            score, found = np.concatenate([best[r][0], score]), np.concatenate([best[r][1], ids[own]])
            first = first_by_score(score, found, k)
            best[r] = score[first], found[first]
    out = [(rows["q_tile"][r], rows["q_place"][r], rows["q_id"][r], int(i), int(s)) for r in range(len(q)) for s, i in zip(*best[r])]
    return pa.Table.from_pylist([dict(zip(("q_tile", "q_place", "query_id", "vec_id", "score"), x)) for x in out], schema=_schema(_FOUND))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_tile", "q_place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, blocks: int = BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows."""
    rows = integer_vectors(vectors.where(F.col("vec_id").isNotNull()), SCALE)
    tiles = tiles_of(rows, "tiles")
    asked = members(tiles, lambda ids: ids % query_step == 0)
    keys, one = ["width", "block", "part"], ["q_tile", "q_place"]
    left, right = blocks_and_tiles(asked, tiles, asked.count())
    lists = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: local_lists(a, b, k, blocks), _LISTS), "lists")
    cutoff = _ranked(lists.where("vec_id is not null"), k).groupBy(*one).agg(F.min("score").alias("cut"), F.count("*").alias("n")).where(F.col("n") == k).select(*one, "cut")
    tops = lists.where("vec_id is null").select(*one, "part", "tiles", "tops")
    armed = left.join(cutoff, one, "left").join(tops, [*one, "part"], "left")
    found = armed.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: collected(a, b, k, blocks), _FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL for the production parameters."""
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v q join v c on q.vec_id % {QUERY_STEP} = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
