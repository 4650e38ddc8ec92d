"""Repeated-substring removal by sparse suffix sorting.

A byte goes if a ``length``-byte string that covers it starts anywhere else too.

Anchors.  Every window of ``length - CONTEXT`` places has one anchor, the place
whose hashed 8 bytes are smallest (the last of equals), so equal strings have
their anchors at equal offsets, with CONTEXT bytes to the right inside the
string.  Anchors whose context occurs once take no further part.

Sorting.  The suffixes at the anchors of one context are sorted deep-shallow:
multikey quicksort to a shallow depth, then a blind trie for each group that
still shares its prefix; the bytes before the anchors are sorted likewise,
backwards.  The common prefixes of neighbours give those of any two anchors, to
the right and to the left, and two that share ``length`` bytes in all prove the
strings in between repeated.  In large groups the order at each place before the
anchors follows from the order behind it by one stable pass over the preceding
bytes, with the common prefixes carried along.

Spread.  Anchors with equal surroundings (by two 64-bit hashes) prove each other
repeated without being compared, so of many copies one is sorted.  A range partitioning by (context,
surroundings, place) spreads them, whatever one surrounding's share.  A context with more
than ``MAX_GROUP`` different surroundings is not gathered: the strings around
its anchors are counted one by one (same results, tested with a small limit).

Results for unusual input: null and empty texts, and texts below ``length``
bytes, keep all bytes; matches never cross documents; a repetition inside one
document counts; exact copies lose every byte; rows that share a doc_id are
separate documents; an empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, text_or_empty
from .shingles import mix

LENGTH, CONTEXT, SHALLOW, MAX_GROUP = 400, 100, 8, 100_000
#: Groups up to this size are compared pair by pair from their sorted orders.
PAIRWISE = 1000
#: Bytes handled at a time.
SLICE_BYTES = 2_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 8 bytes from each place on (of fewer places than bytes)."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    return mix(np.ascontiguousarray(view).view("<u8").ravel() * _FACTOR)


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each run of w, by prefix and suffix minima of blocks of w."""
    n = len(h) - w + 1
    pad = -len(h) % w
    rows = np.concatenate((h, np.full(pad, ~np.uint64(0), np.uint64))).reshape(-1, w)
    down = np.minimum.accumulate(rows, axis=1).ravel()
    up = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, context: int = CONTEXT) -> np.ndarray:
    """Places of a document's anchors: the smallest hashed gram of each run of length - context + 1 places."""
    if len(data) < length:
        return np.zeros(0, np.int64)
    w = length - context + 1
    h = _grams(data)[: len(data) - context + 1]
    least = _window_min(h, w)
    # A place is an anchor if it holds the minimum of a window it lies in; equal grams all count.
    top = np.concatenate((np.full(w - 1, 0, np.uint64), least, np.full(w - 1, 0, np.uint64)))
    return np.flatnonzero(h == ~_window_min(~top, w))


def _shallow(strings: list[bytes], order: list[int], depth: int, limit: int, out: list[list[int]]) -> None:
    """Multikey quicksort to ``limit`` bytes: appends groups, in order, whose members agree so far."""
    work = [(order, depth)]
    while work:
        group, at = work.pop()
        if len(group) == 1 or at >= limit:
            out.append(group)
            continue
        pivot = strings[group[len(group) // 2]][at]
        less = [i for i in group if strings[i][at] < pivot]
        same = [i for i in group if strings[i][at] == pivot]
        more = [i for i in group if strings[i][at] > pivot]
        work += [(g, d) for g, d in ((more, at), (same, at + 1), (less, at)) if g]


def _common(a: bytes, b: bytes, start: int, stop: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    if a[start:stop] == b[start:stop]:
        return stop
    lo, hi = start, stop  # a[:lo] agree, a[:hi] don't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _BlindTrie:
    """Strings of one length by branching places only; a node is [depth, {byte: child}], a leaf [index, equals]."""

    def __init__(self, strings: list[bytes], size: int):
        self.strings, self.size, self.root = strings, size, None

    def insert(self, i: int) -> None:
        s, size = self.strings[i], self.size
        if self.root is None:
            self.root = (size, [i])
            return
        path, node = [], self.root
        while node[0] < size:  # blindly down: only the branching bytes are looked at
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        lcp = _common(s, self.strings[node[1][0]], 0, size)
        if lcp == size:
            node[1].append(i)
            return
        k = next((k for k, p in enumerate(path) if p[0] >= lcp), len(path))
        if k < len(path) and path[k][0] == lcp:
            path[k][1][s[lcp]] = (size, [i])
            return
        below = path[k] if k < len(path) else node
        fork = (lcp, {self.strings[self._any(below)][lcp]: below, s[lcp]: (size, [i])})
        if k == 0:
            self.root = fork
        else:
            path[k - 1][1][s[path[k - 1][0]]] = fork

    def _any(self, node) -> int:
        while node[0] < self.size:
            node = next(iter(node[1].values()))
        return node[1][0]

    def walk(self):
        """(index, common prefix with the one before) in order."""
        stack, lcp = [(self.root, 0)], 0
        while stack:
            node, lcp = stack.pop()
            if node[0] == self.size:
                for n, i in enumerate(node[1]):
                    yield i, lcp if n == 0 else self.size
            else:
                keys = sorted(node[1])
                stack += [(node[1][b], node[0] if n else lcp) for n, b in reversed(list(enumerate(keys)))]


def deep_shallow(strings: list[bytes], size: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before, capped at size) of strings of at least ``size`` bytes."""
    groups: list[list[int]] = []
    _shallow(strings, list(range(len(strings))), 0, min(shallow, size), groups)
    order, lcps = [], []
    for g in groups:
        if len(g) == 1:
            found = [(g[0], 0)]
        elif len(g) == 2:
            a, b = (g if strings[g[0]][:size] <= strings[g[1]][:size] else g[::-1])
            found = [(a, 0), (b, _common(strings[a], strings[b], 0, size))]
        else:
            trie = _BlindTrie(strings, size)
            for i in g:
                trie.insert(i)
            found = list(trie.walk())
        first = found[0][0]
        lcps.append(_common(strings[order[-1]], strings[first], 0, size) if order else 0)
        order.append(first)
        lcps += [x for _, x in found[1:]]
        order += [i for i, _ in found[1:]]
    return np.array(order), np.array(lcps)


def _pairwise(around: list[bytes], left: list[int], length: int, reach: int) -> np.ndarray:
    """As ``repeated_starts``, from the sorted suffixes and the sorted reversed prefixes."""
    k = len(around)
    right = [s[n : n + length] for s, n in zip(around, left)]
    back = [s[n - 1 :: -1] if n else b"" for s, n in zip(around, left)]
    out = np.zeros((k, reach + 2), np.int32)
    if k == 2:
        r = _common_of(*right)
        o = _common_of(*back)
        if o + r >= length:
            out[:, max(0, length - r)] += 1
            out[:, o + 1] -= 1
        return np.cumsum(out, axis=1)[:, : reach + 1] > 0
    shared = []
    for strings, size in ((right, length), (back, reach)):
        ends = np.array([len(x) for x in strings])
        order, lcp = deep_shallow([x.ljust(size, b"\0") for x in strings], size)
        rank = np.empty(k, int)
        rank[order] = np.arange(k)
        shared.append((order, lcp, rank, ends))
    for i in range(k):
        lengths = []
        for order, lcp, rank, ends in shared:
            at = rank[i]
            near = np.empty(k, np.int64)
            near[at] = 0
            near[at + 1 :] = np.minimum.accumulate(lcp[at + 1 :])
            near[:at] = np.minimum.accumulate(lcp[at:0:-1])[::-1]
            own = np.empty(k, np.int64)
            own[order] = near
            lengths.append(np.minimum(np.minimum(own, ends), ends[i]))  # a text's end agrees with nothing
        r, o = lengths
        hit = r + o >= length
        hit[i] = False
        np.add.at(out[i], np.maximum(0, length - r[hit]), 1)
        np.add.at(out[i], o[hit] + 1, -1)
    return np.cumsum(out, axis=1)[:, : reach + 1] > 0


def _common_of(a: bytes, b: bytes) -> int:
    return _common(a, b, 0, min(len(a), len(b)))


def repeated_starts(around: list[bytes], left: list[int], length: int, reach: int) -> np.ndarray:
    """For the anchors of one context: row i, column o tells whether the string that starts o bytes before anchor i is repeated.

    ``around[i]`` holds up to ``reach`` bytes before the anchor (``left[i]`` of
    them) and up to ``length`` from it on.
    """
    return (_pairwise if len(around) <= PAIRWISE else _induced)(around, left, length, reach)


def _induced(around: list[bytes], left: list[int], length: int, reach: int) -> np.ndarray:
    """As ``repeated_starts``, the order at each place from the order behind it."""
    k = len(around)
    full = reach + length + 1
    body = np.zeros((k, full), np.uint8)
    for i, (s, n) in enumerate(zip(around, left)):
        body[i, reach - n : reach - n + len(s)] = np.frombuffer(s, np.uint8)
    after = np.array([len(s) - n for s, n in zip(around, left)])
    before = np.array(left)
    strings = [row.tobytes()[reach : reach + length] for row in body]
    order, lcp = deep_shallow(strings, length)
    # Beyond its end a document agrees with nothing.
    out = np.zeros((k, reach + 1), bool)
    for o in range(reach + 1):
        if o:
            # One byte to the left: a stable sort by that byte keeps the order of the rest.
            prev = body[order, reach - o]
            new = np.argsort(prev, kind="stable")
            seg = np.minimum(_range_min(lcp, new), length - 1) + 1
            same = np.concatenate(([False], prev[new][1:] == prev[new][:-1]))
            order, lcp = order[new], np.where(same, seg, 0)
        fits = (before[order] >= o) & (after[order] + o >= length)
        # A string is repeated if some other fitting one in its run of equals exists.
        run = np.cumsum(np.concatenate(([True], lcp[1:] < length)))
        count = np.bincount(run, weights=fits)
        out[order, o] = fits & (count[run] > 1)
    return out


def _range_min(lcp: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For neighbours new[j-1] < new[j] of one byte: min(lcp[new[j-1]+1 .. new[j]]); anything else elsewhere."""
    k = len(lcp)
    if k == 1:
        return np.zeros(1, lcp.dtype)
    levels = [lcp]
    while 2 ** len(levels) <= k:
        step = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    lo = np.concatenate(([0], new[:-1] + 1))
    hi = new
    span = np.maximum(hi - lo + 1, 1)
    level = np.log2(span).astype(int)
    out = np.zeros(k, lcp.dtype)
    valid = hi >= lo
    for v in np.unique(level[valid]):
        at = np.flatnonzero(valid & (level == v))
        out[at] = np.minimum(levels[v][lo[at]], levels[v][hi[at] - 2**v + 1])
    out[0] = 0
    return out


_ANCHOR = "context long, around long, around2 long, did long, th long, pos int"


def _did() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, did, th, text: a row is known by its id and its text's hash."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long"), _did().alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def _anchor_rows(batches, length: int, context: int):
    reach = length - context
    for b in batches:
        found, held = [], 0
        for did, th, text in zip(b["did"], b["th"], b["text"]):
            if 4 * len(text) < length:
                continue
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            places = anchors(data, length, context)
            if not len(places):
                continue
            n = len(places)
            lo, hi = np.maximum(places - reach, 0), np.minimum(places + length, len(data))
            before = mix((places - lo).astype(np.uint64))
            prints = [_range_prints(data, lo, hi, second) ^ before for second in (False, True)]  # 128 bits, as equal ones count as equal strings
            found.append((_range_prints(data, places, places + context), *prints, np.full(n, did), np.full(n, th), places))
            held += len(data)
            if held > SLICE_BYTES:
                yield _anchor_frame(found)
                found, held = [], 0
        if found:
            yield _anchor_frame(found)


def _anchor_frame(found: list) -> pd.DataFrame:
    context, around, around2, did, th, pos = map(np.concatenate, zip(*found))
    return pd.DataFrame({"context": context.view("<i8"), "around": around.view("<i8"), "around2": around2.view("<i8"), "did": did, "th": th, "pos": pos.astype(np.int32)})


def _range_prints(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of data[lo:hi] for each range, by one of two hashes."""
    from .shingles import _BYTE, _BYTE2, _powers

    up, down = _powers(len(data) + 1, second)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_BYTE2 if second else _BYTE)[data] * up[: len(data)], dtype=np.uint64)))
    return mix((run[hi] - run[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _FACTOR)


def _sift(batches):
    """From rows sorted by (context, around): ``full`` for anchors with an equal surrounding, ``sort`` for one of each surrounding of a context with several.

    What touches a batch's border may go on beyond it and is sorted.
    """
    for b in batches:
        if not len(b):
            continue
        c, a, a2 = b["context"].to_numpy(), b["around"].to_numpy(), b["around2"].to_numpy()
        new_c = np.concatenate(([True], c[1:] != c[:-1]))
        new_a = new_c | np.concatenate(([True], (a[1:] != a[:-1]) | (a2[1:] != a2[:-1])))
        run_c, run_a = np.cumsum(new_c) - 1, np.cumsum(new_a) - 1
        kinds = np.bincount(run_c[new_a])
        open_c = (run_c == 0) | (run_c == run_c[-1])
        full = np.bincount(run_a)[run_a] > 1
        sort = new_a & ((kinds[run_c] > 1) | open_c)
        for kind, rows in (("full", full), ("sort", sort)):
            if rows.any():
                out = b.loc[rows].copy()
                out.insert(0, "kind", kind)
                yield out


def _surroundings(batches, length: int, reach: int):
    for b in batches:
        rows = []
        for did, th, text, places in zip(b["did"], b["th"], b["text"], b["places"]):
            data = text.encode("utf-8", "surrogatepass")
            for p in places:
                pos = p["pos"]
                lo = max(0, pos - reach)
                rows.append((p["context"], did, th, pos, pos - lo, data[lo : pos + length]))
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=["context", "did", "th", "pos", "before", "bytes"])
                rows = []
        yield pd.DataFrame(rows, columns=["context", "did", "th", "pos", "before", "bytes"])


_SPANS = "did long, th long, s int, e int"


def _marked(rows: pd.DataFrame, length: int, reach: int) -> pd.DataFrame:
    """Spans of one context's anchors."""
    starts = repeated_starts(rows["bytes"].tolist(), rows["before"].tolist(), length, reach)
    edge = np.diff(np.pad(starts, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)  # offsets lo .. hi - 1 before the anchor
    pos = rows["pos"].to_numpy()[i]
    return pd.DataFrame({"did": rows["did"].to_numpy()[i], "th": rows["th"].to_numpy()[i], "s": (pos - hi + 1).astype(np.int32), "e": (pos - lo + length).astype(np.int32)})


def _sorted_groups(batches, length: int, reach: int):
    """Runs of one context, over batch borders."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        c = b["context"].to_numpy()
        cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(b)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1]["context"].iloc[0] != c[lo]:
                out.append(_marked(pd.concat(held), length, reach)) if sum(map(len, held)) > 1 else None
                held = []
            if hi < len(b):
                if held:
                    out.append(_marked(pd.concat([*held, b.iloc[lo:hi]]), length, reach))
                    held = []
                elif hi - lo > 1:
                    out.append(_marked(b.iloc[lo:hi], length, reach))
            else:
                held.append(b.iloc[lo:hi])
        if out:
            yield pd.concat(out, ignore_index=True)
    if sum(map(len, held)) > 1:
        yield _marked(pd.concat(held), length, reach)


def _counted(rows: DataFrame, length: int, reach: int) -> DataFrame:
    """Spans of the anchors of contexts too large to gather: every string is counted by its hash."""

    def strings(batches):
        for b in batches:
            for context, did, th, pos, before, raw in zip(b["context"], b["did"], b["th"], b["pos"], b["before"], b["bytes"]):
                data = np.frombuffer(raw, np.uint8)
                lo = np.arange(max(0, len(data) - length + 1))
                lo = lo[lo <= before]
                if len(lo):
                    one, two = (_range_prints(data, lo, lo + length, second).view("<i8") for second in (False, True))
                    yield pd.DataFrame({"context": context, "print": one, "print2": two, "did": did, "th": th, "pos": pos, "s": (pos - before + lo).astype(np.int32)})

    each = rows.mapInPandas(strings, "context long, print long, print2 long, did long, th long, pos int, s int")
    twice = each.groupBy("context", "print", "print2").agg(F.min(F.struct("did", "th", "s")).alias("a"), F.max(F.struct("did", "th", "s")).alias("b")).where("a <> b").select("context", "print", "print2")
    return each.join(twice, ["context", "print", "print2"]).select("did", "th", "s", (F.col("s") + length).alias("e"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, max_group: int = MAX_GROUP) -> DataFrame:
    """did, th, s, e: byte ranges that repeated strings cover; they may reach over a text's ends."""
    spark, reach = docs.sparkSession, length - context
    texts = _identified(docs)
    rows = texts.select("did", "th", "text").mapInPandas(lambda b: _anchor_rows(b, length, context), _ANCHOR)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows, "places")  # else finding the ranges' borders would search all texts once more
    sifted = rows.repartitionByRange(n, "context", "around", "around2", "did", "pos").sortWithinPartitions("context", "around", "around2").mapInPandas(_sift, "kind string, " + _ANCHOR)
    sifted = materialize(sifted, "anchors")
    drop(rows)
    _release(spark)
    to_sort = sifted.where("kind = 'sort'").groupBy("did", "th").agg(F.collect_list(F.struct("context", "pos")).alias("places"))  # of one document
    around = texts.select("did", "th", "text").join(to_sort, ["did", "th"]).mapInPandas(lambda b: _surroundings(b, length, reach), "context long, did long, th long, pos int, before int, bytes binary")
    size = sifted.where("kind = 'sort'").groupBy("context").count().where(F.col("count") > max_group).select("context")
    hot = [] if size.isEmpty() else [size]
    if hot:
        large = materialize(size, "contexts")
        around = materialize(around, "surroundings")
        gathered = around.join(large, "context", "left_anti")
    else:
        gathered = around
    spans = gathered.repartition(n, "context").sortWithinPartitions("context").mapInPandas(lambda b: _sorted_groups(b, length, reach), _SPANS)
    if hot:
        spans = spans.unionByName(_counted(around.join(large, "context", "left_semi"), length, reach))
    spans = materialize(spans, "spans")
    _release(spark)
    full = sifted.where("kind = 'full'").select("did", "th", (F.col("pos") - reach).alias("s"), (F.col("pos") + length).alias("e"))
    return spans.unionByName(full)


def _release(spark) -> None:
    """Let the driver drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deduplicated(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, kept, spans of every whole text: its remaining bytes, and the maximal byte ranges (s, e) that were removed."""
    marks = repeated_spans(docs, length, context, max_group)
    of_doc = marks.groupBy("did", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # of one document

    def cut(batches):
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                if spans is None or not len(spans):
                    rows.append((doc_id, len(raw), raw, []))
                    continue
                step = np.zeros(len(raw) + 1, np.int32)
                for x in spans:
                    lo, hi = max(0, x["s"]), min(len(raw), x["e"])
                    if hi - lo >= length:
                        step[lo] += 1
                        step[hi] -= 1
                gone = np.cumsum(step)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc_id, len(raw), kept, [{"s": s, "e": e} for s, e in zip(edges[::2], edges[1::2])]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "kept", "spans"]).astype({"doc_id": "Int64"})

    joined = _identified(docs).join(of_doc, ["did", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<s: int, e: int>>")


def digests() -> list[F.Column]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``deduplicated`` rows."""
    left = F.length("kept").cast("long")
    return [F.col("doc_id"), F.col("n_bytes"), (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def kept_text() -> F.Column:
    """The remaining bytes as text; what is left of a character that a span cuts in two shows as U+FFFD."""
    return F.make_valid_utf8(F.col("kept").cast("string"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text."""
    return deduplicated(docs, length, context, max_group).select(*digests())
