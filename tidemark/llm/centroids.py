"""Lloyd's clustering with two trees.

Every tile of vectors keeps a cover tree (children lie within a ``BASE``-th of
their parent's radius of their own centre, a parent is its own first child); it
is built once and written with the tile.  Each round builds a cover tree of the
centroids, a few KB, and descends both together: a pair of nodes goes when the
nearest its vectors and centroids can be to each other is beyond the farthest
that some centroid can be from any of those vectors.  A node left with one
centroid is assigned whole; pairs of leaves are compared exactly, in integers.
Tasks return sums and counts a cluster, so what a round gathers is bounded by
the number of clusters, whatever the table.

Results for unusual input: null vectors, vectors of another length than
``width`` and those with null or non-finite components take no part; equal
distances go to the smaller centroid; rows that repeat a vec_id count row by
row, a null vec_id is clustered but starts no centroid before any other; fewer
vectors than clusters start as many centroids as there are vectors; a centroid
without vectors stays; an empty table gives an empty result; extra columns are
ignored.  Components beyond 2**27 (whose distances may not fit in a long) raise
an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import finite, integer_vectors, open_body, tiles_of

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256.0, "2:"
BASE, LEAF, SLACK = 1.3, 16, 1e-9
#: Pairs that are compared at once, and the greatest component.
PAIRS, GREATEST = 1 << 14, 1 << 27


class CoverTree:
    """Nodes as arrays: members ``start`` to ``end`` of the ordered points, of which the first is the centre."""

    FIELDS = ("start", "end", "kid", "kids")

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.order, self.points, self.nodes, self.radius = order, points[order].astype(np.int64), nodes, radius
        self.start, self.end, self.kid, self.kids = nodes
        self.leaf = self.kids == 0
        self.centres = self.points[self.start].astype(float)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> "CoverTree":
        x, order = points.astype(float), np.arange(len(points))
        nodes, radius = [[0, len(x), 0, 0]], []
        at = 0
        while at < len(nodes):
            start, end = nodes[at][:2]
            own = order[start:end]
            far = _apart(x[own], x[own[0]])
            radius.append(float(far.max()))
            if end - start > leaf and radius[at] > 0:
                limit = radius[at] / BASE
                kids, rest = [own[far <= limit]], own[far > limit]
                while len(rest):
                    near = _apart(x[rest], x[rest[0]]) <= limit
                    kids.append(rest[near])
                    rest = rest[~near]
                nodes[at][2:] = [len(nodes), len(kids)]
                for kid in kids:
                    order[start : start + len(kid)] = kid
                    nodes.append([start, start + len(kid), 0, 0])
                    start += len(kid)
            at += 1
        return cls(points, order, np.array(nodes, np.int64).T, np.array(radius) * (1 + SLACK))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, repeated, and the numbers in it."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def nearest(tree: CoverTree, middle: CoverTree) -> np.ndarray:
    """For each ordered point of ``tree`` the number of its nearest centroid."""
    out = np.full(len(tree.points), -1, np.int64)
    most = np.full(len(tree.radius), np.inf)  # some centroid is within this of every member of the node
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends = []
    while len(a):
        apart = _apart(tree.centres[a], middle.centres[b])
        np.minimum.at(most, a, (apart + tree.radius[a]) * (1 + SLACK))
        keep = (apart - tree.radius[a] - middle.radius[b]) * (1 - SLACK) <= most[a]
        a, b = a[keep], b[keep]
        alone = (np.bincount(a, minlength=len(most))[a] == 1) & (middle.end[b] - middle.start[b] == 1)
        for i, j in zip(a[alone], b[alone]):
            out[tree.start[i] : tree.end[i]] = middle.order[middle.start[j]]
        a, b = a[~alone], b[~alone]
        # All pairs of a vector node stay together: first its wide centroid nodes open, then the node itself.
        wide = ~middle.leaf[b] & ((middle.radius[b] > tree.radius[a]) | tree.leaf[a])
        waits = np.bincount(a, wide, minlength=len(most))[a] > 0
        done = ~waits & tree.leaf[a]
        ends.append((a[done], b[done]))
        which, kid = _spread(middle.kid[b[wide]], middle.kids[b[wide]])
        opened = ~waits & ~done
        parent, child = _spread(tree.kid[a[opened]], tree.kids[a[opened]])
        np.minimum.at(most, child, most[a[opened][parent]])
        still = waits & ~wide
        a, b = np.concatenate([a[wide][which], child, a[still]]), np.concatenate([kid, b[opened][parent], b[still]])
    a, b = (np.concatenate(x) for x in zip(*ends))
    least, number = np.full(len(out), np.iinfo(np.int64).max), out.copy()
    # Leaf pairs, exactly: every member against every centroid of the pair.
    which, point = _spread(tree.start[a], tree.end[a] - tree.start[a])
    row, place = _spread(middle.start[b[which]], (middle.end - middle.start)[b[which]])
    point = point[row]
    far = np.empty(len(point), np.int64)
    for at in range(0, len(point), PAIRS):
        d = tree.points[point[at : at + PAIRS]] - middle.points[place[at : at + PAIRS]]
        far[at : at + PAIRS] = np.einsum("ij,ij->i", d, d)
    np.minimum.at(least, point, far)
    best = far == least[point]
    number[point[best]] = np.iinfo(np.int64).max
    np.minimum.at(number, point[best], middle.order[place[best]])
    return number


def _tree_columns(ids, groups, v) -> dict:
    if max(abs(int(v.min(initial=0))), abs(int(v.max(initial=0)))) > GREATEST:
        raise OverflowError("squared distances of these components may not fit in 64 bits")
    t = CoverTree.build(v)
    return {"members": t.order.astype("<i4").tobytes(), "nodes": t.nodes.astype("<i4").tobytes(), "radius": t.radius.astype("<f8").tobytes()}


def _open_tree(r: dict) -> CoverTree:
    v = open_body(r["body"], r["n"], r["width"])
    return CoverTree(v, np.frombuffer(r["members"], "<i4").astype(np.int64), np.frombuffer(r["nodes"], "<i4").reshape(4, -1).astype(np.int64), np.frombuffer(r["radius"], "<f8"))


def _trees(batches):
    for b in batches:
        for i in range(b.num_rows):
            (r,) = b.slice(i, 1).to_pylist()
            yield r, _open_tree(r)


def sums_of(batches, centroids: np.ndarray):
    """A task's vectors and their sum, for each cluster that has any."""
    middle = CoverTree.build(centroids, leaf=1)
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _, t in _trees(batches):
        own = nearest(t, middle)
        n += np.bincount(own, minlength=len(n))
        np.add.at(total, own, t.points)
    some = np.flatnonzero(n)
    yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})


def _members(batches, centroids: np.ndarray):
    middle = CoverTree.build(centroids, leaf=1)
    for r, t in _trees(batches):
        own = nearest(t, middle)
        d = t.points - centroids[own]
        ids = [r["ids"][i] for i in t.order]
        yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(own, pa.int32()), "distance": pa.array(np.einsum("ij,ij->i", d, d))})


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE, seed: str = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors.where(F.size("embedding") == width), scale)
    named = kept.select("vec_id", "v", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"))
    first = named.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).select("v").collect()  # `clusters` rows at most
    empty = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not first:
        return empty
    centroids = np.array([r["v"] for r in first], np.int64)
    tiles = tiles_of(kept, "cover_trees", _tree_columns, "members binary, nodes binary, radius binary")
    for _ in range(rounds):
        now = centroids
        found = tiles.mapInArrow(lambda b: sums_of(b, now), "cluster int, n long, total array<long>")
        sums = found.select("cluster", "n", F.posexplode("total").alias("place", "total")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        centroids = now.copy()
        for r in sums.collect():  # a row a cluster and dimension
            centroids[r["cluster"], r["place"]] = r["total"] // r["n"]
    last = centroids
    assigned = materialize(tiles.mapInArrow(lambda b: _members(b, last), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a cluster
    rows = [(k, v, sum(inertia.values()), hashlib.sha256(",".join(map(str, last[k])).encode()).hexdigest()) for k, v in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(empty.columns)


def oracle() -> str:
    """DuckDB SQL for the production parameters."""
    parts = [
        f"""k as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select cast(row_number() over (order by h nulls last, v) - 1 as integer) as cluster, v from (
    select v, sha256('{SEED}' || cast(vec_id as varchar)) as h from k order by h nulls last, v limit {CLUSTERS})),
r as materialized (select row_number() over () as row, vec_id, v from k)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} as materialized (
  select row, min(vec_id) as vec_id, min({{'d': d, 'cluster': cluster}}) as m from (
    select row, vec_id, cluster, cast(list_sum(list_transform(list_zip(r.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from r cross join c{i})
  group by row)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""s{i} as (
  select cluster, place, cast((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) as bigint) as x  -- exact floor
  from (select m.cluster as cluster, unnest(v) as x, unnest(range(1, {WIDTH} + 1)) as place from a{i} join r using (row)) group by cluster, place),
c{i + 1} as materialized (
  select c{i}.cluster, coalesce(n.v, c{i}.v) as v from c{i}
  left join (select cluster, list(x order by place) as v from s{i} group by cluster) n on n.cluster = c{i}.cluster)"""
            )
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, m.cluster as cluster, m.d as distance,
  cast(sum(m.d) over (partition by m.cluster) as bigint) as cluster_inertia, cast(sum(m.d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} c on c.cluster = m.cluster"""
    )
