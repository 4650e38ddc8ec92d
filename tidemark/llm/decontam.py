"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over neighbouring words that ignores some of them, so a
substituted word under an ignored place doesn't break the hit.  Seeds of every
benchmark item are joined with those of every document; around each hit the item
is laid along the document and the share of its words that agree in place is the
similarity, so substitutions are tolerated wherever they fall.

Words are runs of letters and digits, lower-cased; they are compared by their
64-bit hashes.  The masks are complete: an item with no more than a fifth of its
words substituted keeps all words of one mask somewhere (four in a row, or two
and two around a substitution; three and one in items of five words).  All masks
hold two neighbouring words, and a document's places are first tested against
the benchmark's word pairs, which keeps the seeds that are joined few.  Of runs of
equal seeds, as repetitive texts have, every diagonal is met once.  While the
benchmark holds at most ``max_words`` words, pairs, seeds and items are broadcast;
beyond it the seeds are joined by a shuffle and the hits meet their documents
again (same results, tested).

Results for unusual input: null or empty texts have no words and no hits; an
item with fewer than five words never matches; items with equal texts each
match; a very long text or item is matched as a whole; of equally good places
the first counts; in ``leaks`` documents that share a doc_id share their links
(null ids too) and repeated rows give one link, while ``decontaminate`` judges
each different text by itself; empty tables give an empty result.  Extra columns
are ignored by ``leaks`` and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names

#: Places of each mask from a pair of neighbouring words (0, 1) on; what lies between is ignored.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4))
#: Further masks that items of five words need.
SHORT_MASKS = ((0, 1, 2, 4), (-2, 0, 1, 2))
SIMILARITY = 0.8
MIN_WORDS = 5
#: Words that the benchmark may hold for its seeds, word pairs and items (some 100 bytes a word in all) to be broadcast.
MAX_WORDS = 200_000

_NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hash of each word, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(h: Column, at: Column, places: tuple[int, ...]) -> Column:
    """Hash of a mask's words around a place; null beyond the text's ends."""
    inside = (at + places[0] >= 0) & (at + places[-1] < F.size(h))
    return F.when(inside, F.xxhash64(F.lit(str(places)), *[F.get(h, at + p) for p in places]))


def _pair(h: Column, at: Column) -> Column:
    return F.xxhash64(F.get(h, at), F.get(h, at + 1))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("item"))
    return items.where(F.size("item") >= MIN_WORDS)


def _starts(h: Column, at: Column, places: tuple[int, ...]) -> Column:
    """Whether a mask's seed differs from that of the place before: a run of equal seeds starts here."""
    return F.coalesce(_seed(h, at, places) != _seed(h, at - 1, places), F.lit(True))


def _seeds_at(h: Column, at: Column, masks) -> Column:
    """Every mask's seed at a place, and whether it starts a run."""
    return F.array(*[F.struct(at.alias("at"), F.lit(k).alias("mask"), _seed(h, at, m).alias("seed"), _starts(h, at, m).alias("first")) for k, m in enumerate(masks)])


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """seed, kind, item_id, q: every mask at every place of every item.

    Kind 0 holds all of them, kind 1 those that start a run of equal seeds.  A
    document's place that starts a run asks for kind 0, any other for kind 1: of
    a run against a run that meets every diagonal once, not every pair of places.
    """
    placed = items.select("item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - 2)).alias("q"))
    item, q, short = F.col("item"), F.col("q"), F.size("item") == MIN_WORDS
    # Plain structs, not a filtered array: Spark would keep all rows that an explode makes before a lambda, each with its item.
    seeds = [F.struct(_seed(item, q, m).alias("seed"), _starts(item, q, m).alias("first")) for m in MASKS]
    seeds += [F.struct(F.when(short, _seed(item, q, m)).alias("seed"), _starts(item, q, m).alias("first")) for m in SHORT_MASKS]
    each = placed.select("item_id", "q", F.inline(F.array(*seeds))).where(F.col("seed").isNotNull())
    return each.withColumn("kind", F.explode(F.when(F.col("first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("seed", "kind", "item_id", "q")


def _laid(h: Column, item: Column, start: Column) -> Column:
    """Number of the item's words that agree with the document's when its first word lies at ``start``."""
    return F.aggregate(
        F.sequence(F.greatest(F.lit(0), -start), F.least(F.size(item), F.size(h) - start) - 1),
        F.lit(0),
        lambda n, i: n + F.when(F.get(h, start + i) == F.get(item, i), 1).otherwise(0),
    )


def _agree(h: Column, item: Column, p: Column, q: Column, places: tuple[int, ...]) -> Column:
    """Whether a mask's words agree at p of the document and q of the item; beyond either's ends they don't."""
    inside = (p + places[0] >= 0) & (q + places[0] >= 0)
    same = [F.coalesce(F.get(h, p + k) == F.get(item, q + k), F.lit(False)) for k in places]
    return F.when(inside, reduce(lambda a, b: a & b, same)).otherwise(False)


def _found(docs: DataFrame, keys: list[str], benchmark: DataFrame, similarity: float, max_words: int) -> DataFrame:
    """keys, item_id, start, n_match, n_words of every place where an item lies close enough."""
    items = benchmark_items(benchmark)
    seeds = benchmark_seeds(items)
    texts = docs.select(*keys, word_hashes(F.col("text")).alias("h")).where(F.size("h") >= 2)
    sizes = [F.coalesce(f(F.size("item")), F.lit(0)).alias(n) for f, n in ((F.sum, "words"), (F.min, "least"))]
    shape = items.agg(*sizes).first()
    masks = MASKS + SHORT_MASKS if shape["least"] == MIN_WORDS else MASKS

    def asked(places: Column) -> Column:
        return F.filter(F.flatten(F.transform(places, lambda i: _seeds_at(F.col("h"), i, masks))), lambda s: s["seed"].isNotNull())

    kind = F.when(F.col("s.first"), 0).otherwise(1).alias("kind")

    # Word pairs, seeds and items are all in proportion to the benchmark's words, so their number bounds what is broadcast.
    if shape["words"] <= max_words:
        pairs = items.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("item") - 2), lambda q: _pair(F.col("item"), q))).alias("pair")).distinct()
        known = [r[0] for r in pairs.collect()] or [0]
        listed = ",".join(f"{v}L" if v > -(2**63) else "(-9223372036854775807L-1L)" for v in known)
        # Bound as a lambda's argument, the hashes are made once a row.
        near = F.expr(f"transform(array(h), x -> filter(sequence(0, size(x) - 2), i -> xxhash64(x[i], x[i + 1]) in ({listed})))[0]")
        held = texts.withColumn("near", near).where(F.size("near") > 0)
        placed = held.select(*keys, "h", F.explode(asked(F.col("near"))).alias("s"))
        placed = placed.select(*keys, "h", F.col("s.at").alias("p"), "s.mask", "s.seed", kind)
        hits = placed.join(F.broadcast(seeds), ["seed", "kind"]).join(F.broadcast(items), "item_id")
        # Of a run of hits of one mask along one diagonal the first is measured.
        before = [F.when(F.col("mask") == k, _agree(F.col("h"), F.col("item"), F.col("p") - 1, F.col("q") - 1, m)) for k, m in enumerate(masks)]
        laid = hits.where(~F.coalesce(*before, F.lit(False))).select(*keys, "item_id", "h", "item", (F.col("p") - F.col("q")).alias("start"))
    else:
        places = F.sequence(F.lit(0), F.size("h") - 2)
        wide = texts.select(*keys, F.xxhash64("h").alias("row"), F.explode(asked(places)).alias("s")).select(*keys, "row", F.col("s.at").alias("p"), "s.seed", kind)
        hits = wide.join(seeds, ["seed", "kind"]).select(*keys, "row", "item_id", (F.col("p") - F.col("q")).alias("start")).distinct()
        same = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, "row"]])
        laid = (
            hits.alias("x")
            .join(texts.withColumn("row", F.xxhash64("h")).distinct().alias("d"), same)
            .join(items.alias("i"), F.expr("x.item_id = i.item_id"))
            .select(*[F.col(f"x.{k}") for k in keys], F.col("x.item_id"), F.col("d.h"), F.col("i.item"), F.col("x.start"))
        )
    measured = laid.select(*keys, "item_id", "start", _laid(F.col("h"), F.col("item"), F.col("start")).alias("n_match"), F.size("item").alias("n_words"))
    return measured.where(F.col("n_match") >= F.lit(similarity) * F.col("n_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id, start, n_match, n_words, similarity: each document's best place of each item it holds.

    ``start`` is the place (in words) at which the item's first word lies.
    """
    close = _found(docs.select("doc_id", "text"), ["doc_id"], benchmark, similarity, max_words)
    best = close.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("n_match", (-F.col("start")).alias("back"))).alias("b"))
    return best.select(
        "doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start"), F.col("b.n_match").cast("long").alias("n_match"), F.col("n_words").cast("long").alias("n_words"),
        F.round(F.col("b.n_match") / F.col("n_words"), 6).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows whose text holds no benchmark item, with their own columns, whatever their names.

    A row is known by its doc_id and a 128-bit hash of its text.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one, two = fresh_names(docs, "one", "two")
    marked = docs.withColumn(one, F.xxhash64(t)).withColumn(two, F.xxhash64(t, F.lit(1)))
    rows = marked.select("doc_id", F.col(one).alias("t1"), F.col(two).alias("t2"), "text")
    found = _found(rows, ["doc_id", "t1", "t2"], benchmark, similarity, max_words).select(F.col("doc_id").alias("leak"), "t1", "t2").distinct()
    same = marked["doc_id"].eqNullSafe(found["leak"]) & (marked[one] == found["t1"]) & (marked[two] == found["t2"])
    return marked.join(found, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
