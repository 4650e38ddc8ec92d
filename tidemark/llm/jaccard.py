"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection.

Sets.  A document's set is its distinct ``shingle``-word shingles, as sorted
64-bit hashes.  Documents with equal sets form a class (one aggregation), and
all further work is on classes.

Tiles.  Two sets of at most U elements that link differ in at most d(U)
elements.  Sets are banded by size; in each band a set is dealt by hash into
more than d(U) parts, so two sets that link have equal, non-empty parts in
common.  A tile is (band, part, content of the part): no link is lost, and
documents that merely share passages rarely share a tile.

Bounds.  Each set has a parity bitmap: one bit a bucket, flipped by each of its
elements.  The bits in which two bitmaps differ bound the sets' difference from
below, hence their overlap from above; only pairs that pass are intersected.

Groups.  Only connectivity is asked for, so a tile never emits all its pairs:
first each member is held against the tile's smallest id; tiles that still hold
several components are searched again with bitmaps, large ones first for a
spanning set of likely links, then all for every remaining pair between
different components.
Tiles above a block's members or bytes are cut into blocks that meet in pairs.

Sets are held as 64-bit hashes; that two shingles of one compared pair share
one has odds of about |A| |B| / 2**64.

Results for unusual input: null and empty texts have no set and are their own
component; a very long text is one array of its own length, whatever the slice;
ties don't arise, as a component has one smallest id; rows that share a doc_id
count as one document that holds all their links; a null doc_id takes the
component of an equal set, else null, and joins nothing; repeated rows and exact
copies share a component; an empty table gives an empty result.  Extra columns
are ignored, or kept by ``keep_first`` whatever their names; that judges rows
by themselves, so unlike texts of one doc_id both stay.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, likely_in, materialize, split_by_bytes, text_or_empty, whole_runs
from .graph import connected_components
from .shingles import mix, shingle_sets

#: Characters handled at a time, bits of a bitmap an element.
SLICE_CHARS, BITS = 250_000, 4
#: Members of a block of a tile: at most, at least, and bytes of their bitmaps (at most a byte an element).
BLOCK, LEAST_BLOCK, BLOCK_BYTES = 4096, 16, 16_000_000
#: Tiles above this are searched for a spanning set before all their pairs.
SPAN_FIRST = 32


def band(n: int) -> int:
    """Bands grow by a factor of 2**0.5: band k holds the sizes from 2**(k/2) on."""
    k = max(0, 2 * n.bit_length() - 2)
    return k + 1 if n * n >= 2 ** (k + 1) else k


@lru_cache(maxsize=None)
def _largest(k: int) -> int:
    """The largest size in a band."""
    from math import isqrt

    return isqrt(2 ** (k + 1) - 1)


@lru_cache(maxsize=None)
def parts_of(k: int, percent: int) -> tuple[int, int]:
    """(number of parts, how many of them may be empty without losing a link) for pairs whose larger set is in band k."""
    d = 2 * _largest(k) * (100 - percent) // (100 + percent)
    if d == 0:
        return 0, 0  # sets that link are equal
    spare = d // 8 + 2 if d >= 4 else 0
    return d + 1 + spare, spare


def part_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a set."""
    n = len(h)
    own = band(n)
    bands = [own] + ([own + 1] if n * 100 >= percent * (_largest(own) + 1) else [])
    out = []
    for k in bands:
        p, spare = parts_of(k, percent)
        if not p:
            continue
        part = (h % np.uint64(p)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        content = mix(np.add.reduceat(mix(h[order] + np.uint64(k + 1)), first))
        if p - len(filled) > spare:  # so many parts are empty that they count as well
            every = np.zeros(p, np.uint64)
            every[filled] = content
            filled, content = np.arange(p), every
        out.append(mix(content + mix(filled.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(k))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity bitmap of about BITS bits an element, a power of two."""
    bits = max(64, 1 << (BITS * max(1, len(h)) - 1).bit_length())
    flips = np.bincount((h >> np.uint64(20)).astype(np.uint64) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller width: buckets that fall together add their parities."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(n1, n2, differing, percent: int):
    """Whether sets of these sizes that differ in at least so many elements can reach the threshold."""
    overlap = np.minimum((n1 + n2 - differing) // 2, np.minimum(n1, n2))
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def signatures(docs: DataFrame, shingle: int, percent: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """row (a number), doc_id, n, fingerprint of the set, its tiles as raw 64-bit keys, and ``extra`` long columns."""

    def sign(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in split_by_bytes(texts, SLICE_CHARS):
                sets = shingle_sets(texts[part], shingle)
                own = b.slice(part.start, part.stop - part.start)
                columns = {"doc_id": own.column("doc_id"), **{c: own.column(c) for c in extra}}
                columns["n"] = pa.array([len(s) for s in sets], pa.int64())
                columns["print"] = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                columns["tiles"] = pa.array([part_keys(s, percent).astype("<u8").tobytes() for s in sets], pa.binary())
                yield pa.record_batch(columns)

    named = "".join(f"{c} long, " for c in extra)
    texts = docs.select(F.col("doc_id").cast("long"), *extra, text_or_empty().alias("text"))
    return texts.mapInArrow(sign, f"doc_id long, {named}n long, print binary, tiles binary").withColumn("row", F.monotonically_increasing_id())


def _shared_tiles(classes: DataFrame) -> DataFrame:
    """(tile, id) of the tiles that hold two classes or more, and a few others.

    A range partitioning by (tile, id) spreads a tile of any size; a tile that
    reaches a batch's border counts as shared.
    """

    def explode(batches):
        for b in batches:
            keys = [np.frombuffer(t, "<i8") for t in b.column("tiles").to_pylist()]
            ids = np.repeat(b.column("id").to_numpy(), [len(k) for k in keys])
            yield pa.record_batch({"tile": pa.array(np.concatenate(keys) if keys else np.zeros(0, "<i8")), "id": pa.array(ids, pa.int64())})

    def repeated(batches):
        for b in batches:
            t = b.column("tile").to_numpy()
            if len(t):
                same = t[1:] == t[:-1]
                yield b.filter(pa.array(np.concatenate(([True], same)) | np.concatenate((same, [True]))))

    rows = classes.mapInArrow(explode, "tile long, id long")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "tile", "id").sortWithinPartitions("tile", "id").mapInArrow(repeated, "tile long, id long")


def _distinct_tiles(shared: DataFrame, least: int) -> DataFrame:
    """Tiles of at least so many members, one of those with equal members: tile, pivot, members."""
    sizes = shared.groupBy("tile").agg(
        F.count("*").alias("members"), F.min("id").alias("pivot"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")
    )
    return sizes.where(F.col("members") >= least).groupBy("members", "pivot", "x", "y").agg(F.min("tile").alias("tile")).select("tile", "pivot", "members")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link: bitmaps first, then the exact intersection of what passes."""

    def kept(b, keep: list[bool]):
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def bounded(batches):
        for b in batches:
            keep = []
            for n1, n2, m1, m2 in zip(*[b.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]):
                m1, m2 = np.frombuffer(m1, np.uint64), np.frombuffer(m2, np.uint64)
                width = min(len(m1), len(m2))
                keep.append(bool(may_link(n1, n2, int(np.bitwise_count(fold(m1, width) ^ fold(m2, width)).sum()), percent)))
            yield kept(b, keep)

    def exact(batches):
        for b in batches:
            keep = []
            for s1, s2 in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                overlap = len(np.intersect1d(np.frombuffer(s1, "<u8"), np.frombuffer(s2, "<u8"), assume_unique=True))
                keep.append(100 * overlap >= percent * ((len(s1) + len(s2)) // 8 - overlap))
            yield kept(b, keep)

    def with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("b", "a"):
            own = table.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
            pairs = pairs.join(own, side)
        return pairs

    passing = materialize(with_both(pairs, sets, ["n", "bits"]).mapInArrow(bounded, "a long, b long"), "passing")
    ends = passing.select(F.col("a").alias("id")).union(passing.select("b")).distinct()
    return with_both(passing, likely_in(sets.select("id", "set"), "id", ends), ["set"]).mapInArrow(exact, "a long, b long")


def _tile_pairs(ids, comp, sizes, bits, side, percent: int, every: bool):
    """Index pairs of a tile that may link, between different components.

    ``every``: all of them; else a spanning set: a member that has been reached
    is not offered again.
    """
    width = min(map(len, bits))
    m = np.stack([fold(b, width) for b in bits])

    def passing(i, others):
        ok = comp[others] != comp[i]
        if side is not None:
            ok &= side[others] != side[i]
        others = others[ok]
        differing = np.bitwise_count(m[others] ^ m[i]).sum(axis=1).astype(np.int64)
        return others[may_link(sizes[others], sizes[i], differing, percent)]

    k = len(ids)
    if every:
        for i in range(k - 1):
            for j in passing(i, np.arange(i + 1, k)):
                yield i, j
        return
    waiting = np.ones(k, bool)
    for start in range(k):
        if not waiting[start]:
            continue
        stack = np.flatnonzero(waiting & (comp == comp[start])).tolist()
        waiting[comp == comp[start]] = False
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(waiting)
            if not len(rest):
                break
            for j in passing(i, rest):
                if waiting[j]:
                    yield i, j
                    reached = np.flatnonzero(waiting & (comp == comp[j]))
                    waiting[reached] = False
                    stack += reached.tolist()


def _candidates(tiles: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, every: bool, block: int) -> DataFrame:
    """Pairs between different components that may link, from tiles (tile, pivot, members, id).

    Members of the pivot's component meet the others only, not each other, so
    what a tile sends grows with the product of the two and not with its square.
    Blocks hold at most ``block`` members and about BLOCK_BYTES of bitmaps.
    """
    known = sets.select("id", "n").join(labels, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    rows = tiles.join(known, "id")
    pivot = F.max(F.when(F.col("id") == F.col("pivot"), F.col("component"))).alias("main")
    spread = rows.groupBy("tile").agg(pivot, F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("most")).where("lo <> hi").select("tile", "main", "most")
    rows = rows.join(spread, "tile")
    room = F.greatest(F.lit(min(block, LEAST_BLOCK)), F.least(F.lit(block), (F.lit(BLOCK_BYTES) / F.col("most")).cast("long")))
    sizes = rows.groupBy("tile").agg(F.count_if(F.col("component") == F.col("main")).alias("inner"), F.count("*").alias("all"))
    rows = rows.join(sizes, "tile").withColumn("others", F.ceil((F.col("all") - F.col("inner")) / room).cast("int")).withColumn("mains", F.ceil(F.col("inner") / room).cast("int"))
    inside = F.col("component") == F.col("main")
    own = F.when(inside, F.col("others") + F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    met = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains"))  # blocks 0 .. others - 1 meet all blocks
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1))).join(sets.select("id", "bits"), "id")
    rows = rows.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "bits")

    def search(batches):
        for t in whole_runs(batches, ["tile", "i", "j"]):
            key = np.stack([t.column(c).to_numpy().astype("<i8") for c in ("tile", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            ids, component, sizes, own = (t.column(c).to_numpy().astype("<i8") for c in ("id", "component", "n", "own"))
            found = [np.zeros((0, 2), "<i8")]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    bits = [np.frombuffer(x, np.uint64) for x in t.column("bits").slice(lo, hi - lo).to_pylist()]
                    side = own[lo:hi] if key[1, lo] != key[2, lo] else None
                    pairs = list(_tile_pairs(ids[lo:hi], component[lo:hi], sizes[lo:hi], bits, side, percent, every))
                    if pairs:
                        found.append(ids[lo:hi][np.array(pairs)])
            at = np.concatenate(found)
            yield pa.record_batch({"a": pa.array(at.min(axis=1, initial=2**63 - 1)), "b": pa.array(at.max(axis=1, initial=-(2**63)))})

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "id").mapInArrow(search, "a long, b long").distinct()


def link_classes(docs: DataFrame, shingle: int, percent: int, block: int = BLOCK, tied: bool = True, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(signatures: row, doc_id, extra, n, print; classes: n, print, id, doc_id, component) of all documents with a set.

    A class is known by the least row number of its rows, so rows of different
    sets never fall together, whatever their doc_id.  ``tied``: rows that share a
    doc_id tie their sets together.
    """
    signed = materialize(signatures(docs, shingle, percent, extra), "signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    class_of = usable.groupBy("n", "print")
    shared = materialize(_shared_tiles(class_of.agg(F.min("row").alias("id"), F.first("tiles").alias("tiles")).select("id", "tiles")), "tiles")
    ids = materialize(class_of.agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "classes")
    several = usable.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("print").alias("lo"), F.max("print").alias("hi")).where("rows > 1")
    several = materialize(several, "repeated")
    repeated = not several.isEmpty()

    tiles = materialize(_distinct_tiles(shared, 2), "tiles")
    members = materialize(shared.join(tiles, "tile").select("tile", "members", "pivot", "id"), "members")
    sets = materialize(_sets(docs, ids.join(members.select("id").distinct(), "id").select("id", "doc_id", "print"), shingle, repeated), "sets")
    stars = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_linked(stars, sets, percent), "links")
    if tied and repeated:
        both = usable.select("doc_id", "n", "print").join(several.where("lo <> hi").select("doc_id"), "doc_id").distinct().join(ids.select("n", "print", "id"), ["n", "print"])
        first = both.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = links.unionByName(materialize(both.join(first, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct(), "ties"))
    labels = connected_components(links)
    # Large tiles are first searched for a spanning set, so that few of their pairs are left.
    for least, every in ((SPAN_FIRST, False), (2, True)):
        pairs = materialize(_candidates(members.where(F.col("members") > least), sets, labels, percent, every, block), "pairs")
        if pairs.isEmpty():
            continue
        links = links.unionByName(materialize(_linked(pairs, sets, percent), "links"))
        labels = connected_components(links)
    classes = ids.join(labels, "id", "left").select("n", "print", "id", "doc_id", F.coalesce("component", "id").alias("component"))
    return signed.drop("tiles"), classes


def _sets(docs: DataFrame, needed: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """id, n, bits, set of the named classes (id, doc_id, print), from the whole text of one document each."""

    def make(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in split_by_bytes(texts, SLICE_CHARS):
                sets = shingle_sets(texts[part], shingle)
                own = b.slice(part.start, part.stop - part.start)
                if repeated:  # other rows of this doc_id have other sets
                    same = [blake2b(s.tobytes(), digest_size=16).digest() == p for s, p in zip(sets, own.column("print").to_pylist())]
                    sets, own = [s for s, k in zip(sets, same) if k], own.filter(pa.array(same, pa.bool_()))
                yield pa.record_batch(
                    {
                        "id": own.column("id"),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "bits": pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                        "set": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                    }
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = likely_in(texts, "doc_id", needed.select("doc_id").distinct()).join(needed, "doc_id").mapInArrow(make, "id long, n long, bits binary, set binary")
    return found.dropDuplicates(["id"]) if repeated else found


def jaccard_components(docs: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: linked when 100 |A & B| >= percent |A | B|."""
    signed, classes = link_classes(docs, shingle, percent, block)
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = classes.join(least, "component").select("n", "print", "component_id")
    found = signed.join(known, ["n", "print"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the smallest doc_id; rows without words all stay.

    A row is known by its doc_id and a 128-bit hash of its text, so of rows that
    share a doc_id each different text is judged by itself.
    """
    t = text_or_empty()
    one, two, key = fresh_names(docs, "one", "two", "id")
    marked = docs.withColumn(one, F.xxhash64(t)).withColumn(two, F.xxhash64(t, F.lit(1)))
    seen = marked.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), F.col(one).alias("t1"), F.col(two).alias("t2"))
    signed, classes = link_classes(seen, shingle, percent, tied=False, extra=("t1", "t2"))
    named = signed.join(classes.select("n", "print", "component"), ["n", "print"], "left")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "t1", "t2")
    # Rows whose doc_ids are all null have no component: of equal sets one row stays.
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("print"))]
    first = named.where("n > 0").groupBy(*group).agg(F.min(place).alias("k"), F.count("*").alias("rows")).select("k.doc_id", "k.t1", "k.t2")
    wordless = named.where("n = 0").select("doc_id", "t1", "t2").distinct()
    kept = first.union(wordless).select(F.col("doc_id").alias(key), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    same = marked["doc_id"].cast("long").eqNullSafe(kept[key]) & (marked[one] == kept["_t1"]) & (marked[two] == kept["_t2"])
    joined = marked.join(kept, same, "left_semi")
    repeated = signed.where("n > 0").groupBy("doc_id", "t1", "t2").count().where("count > 1")
    if not repeated.isEmpty():
        words = t.rlike(r"[^\x20\x09-\x0D]")
        joined = joined.where(~words).unionByName(joined.where(words).dropDuplicates(["doc_id", one, two]))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
