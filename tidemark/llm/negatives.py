"""Hard negatives by a vector-approximation file.

Every tile of vectors keeps an approximation of its own: each dimension's range
is cut into ``CELLS`` cells, and a vector is stored as the numbers of its cells.
For an anchor a table of its least and greatest product with each cell of each
dimension turns a candidate's cells into bounds of its score, by look-up and
addition alone.  Only candidates whose bounds can still enter an anchor's
window are scored exactly, from the vectors themselves:

1. positives: among the rows of the anchor's group, candidates whose upper
   bound reaches the best exact scores and lower bounds met so far;
2. negatives: among the rows of other groups, the same within each window
   [floor_percent * positive <= 100 * score <= 100 * positive].

A part of the tiles yields at most ``k`` rows for an anchor or a window, whatever
the number of candidates, and a window over those gives the first ``k`` of all.

Results for unusual input: rows with a null group, a null vector, or a null or
non-finite component take no part, nor do rows with a null vec_id; vectors are
compared with those of their own length; rows that repeat a vec_id count row by
row, as anchors and as candidates (an anchor is never its own candidate, but
another row of its id is); equal scores go by vec_id; fewer than k give all;
an empty table gives an empty result; extra columns are ignored.  Scores beyond
64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import blocks_and_tiles, body_of, check_products, first_by_score, integer_vectors, members, open_body, tiles_of

CELLS, SCALE, ANCHOR_STEP, K, FLOOR_PERCENT = 128, 256.0, 100, 5, 80


def approximation(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least value and the width of a cell for each dimension, and each vector's cells."""
    low = v.min(axis=0)
    step = np.maximum(1, -(-(v.max(axis=0) - low + 1) // CELLS))
    return low, step, ((v - low) // step).astype(np.uint8)


def _cell_columns(ids, groups, v) -> dict:
    low, step, cells = approximation(v)
    return {"low": low.astype("<i8").tobytes(), "step": step.astype("<i8").tobytes(), "cells": cells.tobytes()}


class Approximated:
    """An opened tile: bounds of scores by look-up, exact scores of chosen places."""

    def __init__(self, tile: dict):
        n, width = tile["n"], tile["width"]
        self.tile, self.ids, self.groups = tile["tile"], np.array(tile["ids"], np.int64), np.array(tile["groups"], np.int64)
        self.v = open_body(tile["body"], n, width)
        low, step = (np.frombuffer(tile[c], "<i8") for c in ("low", "step"))
        self._low = low[:, None] + step[:, None] * np.arange(CELLS)  # least value of each cell
        self._span = step - 1
        self._at = np.frombuffer(tile["cells"], np.uint8).reshape(n, width) + np.arange(width) * CELLS

    def bounds(self, q: np.ndarray, rows: np.ndarray | slice) -> tuple[np.ndarray, int]:
        """Lower bounds of the rows' scores; an upper bound is a lower one and the second value."""
        least = (q[:, None] * self._low + np.minimum(q * self._span, 0)[:, None]).ravel()
        return np.take(least, self._at[rows]).sum(axis=1), int((np.abs(q) * self._span).sum())

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.v[rows].astype(np.int64) @ q

    def of_group(self, group: int) -> tuple[int, int]:
        return int(np.searchsorted(self.groups, group)), int(np.searchsorted(self.groups, group, "right"))


class Best:
    """The first k (score, id) met so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
            first = first_by_score(score, ids, self.k)
            self.score, self.ids = score[first], ids[first]

    def least(self, floor):
        """No score below this one can enter."""
        return max(floor, self.score[-1]) if len(self.score) == self.k else floor


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def candidates(low: np.ndarray, gap: int, best: Best, floor, ceiling) -> np.ndarray:
    """Places whose bounds [low, low + gap] can still enter the window [floor, ceiling]."""
    least = best.least(floor)
    near = np.flatnonzero((low + gap >= least) & (low <= ceiling))
    if len(near) > best.k:  # k candidates are surely inside and score their lower bounds at least
        sure = low[near]
        sure = sure[(sure >= floor) & (sure + gap <= ceiling)]
        kth = _kth(sure, best.k)
        if kth is not None and kth > least:
            near = near[low[near] + gap >= kth]
    return near


NONE = np.iinfo(np.int64).min
ALL = np.iinfo(np.int64).max


def _queries(left: pa.Table):
    rows = left.to_pylist()
    for r in rows:
        r["q"] = open_body(r["q_body"], 1, r["width"])[0].astype(np.int64)
    return rows


def _tiles(right: pa.Table):
    for i in range(right.num_rows):
        yield Approximated(right.slice(i, 1).to_pylist()[0])


_POSITIVE = "q_tile long, q_place int, q_id long, q_group long, width int, q_body binary, positive_id long, positive_score long"
_NEGATIVE = "q_tile long, q_place int, anchor_id long, w int, positive_id long, positive_score long, negative_id long, negative_score long"


def _frame(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))]))


def best_of_group(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Each query's k best other rows of its group in one part of the tiles."""
    asked = _queries(left)
    best = [Best(k) for _ in asked]
    for t in _tiles(right):
        for r, b in zip(asked, best):
            start, end = t.of_group(r["q_group"])
            if start == end:
                continue
            check_products(r["q"][None], t.v[start:end])
            low, gap = t.bounds(r["q"], slice(start, end))
            if r["q_tile"] == t.tile:
                low[r["q_place"] - start] = NONE // 2
            near = start + candidates(low, gap, b, NONE // 4, ALL)
            b.add(t.exact(r["q"], near), t.ids[near])
    keep = ("q_tile", "q_place", "q_id", "q_group", "width", "q_body")
    return _frame([{c: r[c] for c in keep} | {"positive_id": int(i), "positive_score": int(s)} for r, b in zip(asked, best) for s, i in zip(b.score, b.ids)], _POSITIVE)


def best_in_windows(left: pa.Table, right: pa.Table, k: int, floor_percent: int) -> pa.Table:
    """The first k rows of other groups in each window of each anchor, in one part of the tiles."""
    asked = _queries(left)
    for r in asked:
        # the window of a negative score is empty
        r["windows"] = [(w, p, -(-floor_percent * p["positive_score"] // 100), p["positive_score"], Best(k)) for w, p in enumerate(r["positives"]) if p["positive_score"] >= 0]
        r["least"] = min((w[2] for w in r["windows"]), default=None)
    for t in _tiles(right):
        for r in asked:
            if not r["windows"]:
                continue
            start, end = t.of_group(r["q_group"])
            others = np.r_[0:start, end : len(t.ids)]
            if not len(others):
                continue
            check_products(r["q"][None], t.v)
            low, gap = t.bounds(r["q"], others)
            possible = np.flatnonzero(low + gap >= r["least"])
            chosen = [possible[candidates(low[possible], gap, w[4], w[2], w[3])] for w in r["windows"]]
            near = np.unique(np.concatenate(chosen))
            score, ids = t.exact(r["q"], others[near]), t.ids[others[near]]
            for _, _, floor, ceiling, b in r["windows"]:
                own = (score >= b.least(floor)) & (score <= ceiling)
                b.add(score[own], ids[own])
    return _frame(
        [
            {"q_tile": r["q_tile"], "q_place": r["q_place"], "anchor_id": r["q_id"], "w": w, **p, "negative_id": int(i), "negative_score": int(s)}
            for r in asked
            for w, p, _, _, b in r["windows"]
            for s, i in zip(b.score, b.ids)
        ],
        _NEGATIVE,
    )


def hard_negatives(
    vectors: DataFrame, label: Column | None = None, *, k: int = K, anchor_step: int = ANCHOR_STEP, floor_percent: int = FLOOR_PERCENT, scale: float = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    ``label`` is the group of a row, the column ``label`` by default.  Anchors are the rows whose vec_id is divisible by ``anchor_step``.
    """
    label = F.col("label") if label is None else label
    rows = integer_vectors(vectors.where(F.col("vec_id").isNotNull() & label.isNotNull()), scale, label)
    tiles = tiles_of(rows, "approximations", _cell_columns, "low binary, step binary, cells binary")
    anchors = members(tiles, lambda ids: ids % anchor_step == 0)
    n_anchors = anchors.count()
    keys = ["width", "block", "part"]

    left, right = blocks_and_tiles(anchors, tiles, n_anchors)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: best_of_group(a, b, k), _POSITIVE)
    one = ["q_tile", "q_place"]
    order = Window.partitionBy(*one).orderBy(F.desc("positive_score"), "positive_id")
    ranked = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    # k positives of an anchor at most
    positives = F.transform(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))), lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score")))
    armed = ranked.groupBy(*one).agg(*[F.first(c).alias(c) for c in ("q_id", "q_group", "width", "q_body")], positives.alias("positives"))

    left, right = blocks_and_tiles(armed, tiles, n_anchors)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: best_in_windows(a, b, k, floor_percent), _NEGATIVE)
    order = Window.partitionBy(*one, "w").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(step: int = 7, labels: int = 10) -> Column:
    """The label of the production query: the next one for every ``step``-th id."""
    return F.when(F.col("vec_id") % step == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def oracle() -> str:
    """DuckDB SQL for the production parameters."""
    return f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
    cast(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v a join v c on a.vec_id % {ANCHOR_STEP} = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same),
n as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and p.r <= {K}
    and {FLOOR_PERCENT} * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {K}"""
