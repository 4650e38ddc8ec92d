"""Content-addressed store of token ids.

A rolling hash over a document's ids cuts them into chunks at places that the
content decides, so equal passages give equal chunks.  Each different chunk is
stored once under the SHA-256 of its bytes; a recipe lists a document's chunks
in order together with their Merkle root, and a manifest holds one Merkle root
for each slice of recipes and one for the whole store.  Reading checks every
chunk against its address and every recipe against its root.

Layout under one path: ``objects/kind=chunk`` (address, payload),
``objects/kind=recipe`` (a document's addresses), ``recipes`` (sorted by doc_id,
with the first id's place in the whole stream), ``manifest``.

Results for unusual input: null texts count as empty; an empty text is just its
end id; documents with the same doc_id stay separate rows, ordered by their
root; a null doc_id comes first; a very long text is encoded as a whole and cut
like any other; an empty table gives an empty store.  Extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache
from hashlib import sha256
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import text_or_empty
from .units import UnitCache, distinct_pieces

END_ID = 0
#: Chunks hold at least MIN_IDS ids (but for a document's last) and at most MAX_IDS, about MEAN_IDS beyond the least.
MIN_IDS, MEAN_IDS, MAX_IDS = 256, 1024, 8192
_WINDOW = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Distinct units whose ids one Python worker remembers, and characters encoded at a time.
CACHE_UNITS, SLICE_CHARS = 1_000_000, 12_000_000

#: A word, the marks after it, and the first word of the next line: each is a pre-token.
_PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)(?:([!-&(-/:-@\[-`{-~]+)(?:\n([A-Za-zÀ-ÖØ-öø-ɏ]+))?)?").fullmatch
_BYTE_CHARS = dict(enumerate(byte_alphabet()))
_OBJECT = "kind string, key binary, doc_id long, n_tokens long, payload binary"


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, {}, {}, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _encoded(tokenizer, known: dict, units: list[str], lead: str, limit: int) -> list[bytes]:
    """The ids of each of some different units.

    A word is one pre-token, so the library's model takes it as it is, in the
    byte alphabet, without its normalised strings and offsets; units of another
    form go through the whole tokenizer.  ``known`` remembers words without the
    marks after them, and units of another form; when it is full, only those
    that are needed now stay.
    """
    parts = [(u, "", "") if u.isalpha() and u.isascii() else (m.groups("") if (m := _PARTS(u)) else None) for u in units]  # most are a plain word
    words, other = {p[0] for p in parts if p}, [u for u, p in zip(units, parts) if p is None]
    new_words, new_other = words.difference(known), [u for u in other if u not in known]
    if len(known) + len(new_words) + len(new_other) > limit:
        kept = {u: known[u] for u in (*words.difference(new_words), *set(other).difference(new_other))}
        known.clear()
        known.update(kept)
    tokenize, space = tokenizer.model.tokenize, lead and _BYTE_CHARS[ord(lead)]

    def word(w: str, before: str) -> bytes:
        chars = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in tokenize(before + chars)]).tobytes()

    def plain(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    marks, bare = UnitCache(plain, limit), UnitCache(lambda w: word(w, ""), limit)
    for w in new_words:
        known[w] = word(w, space)
    for u, e in zip(new_other, tokenizer.encode_batch_fast([lead + u for u in new_other], add_special_tokens=False)):
        known[u] = array("I", e.ids).tobytes()

    def whole(u: str, p: tuple[str, str, str] | None) -> bytes:
        if p is None or not p[1]:
            return known[u]
        return known[p[0]] + marks[p[1] + "\n"] + bare[p[2]] if p[2] else known[p[0]] + marks[p[1]]

    return [whole(u, p) for u, p in zip(units, parts)]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each whole text as little-endian 32-bit integers, by the tokenizers library.

    The library encodes every distinct unit (see ``units``) once per worker, and a
    call looks each up once; arrays of places put their ids in the texts' order;
    texts that hold an added token's string go through it as a whole.
    """
    if not texts:
        return []
    tokenizer, first, later, added = _library(path)
    whole = {i for i, t in enumerate(texts) if any(a in t for a in added)}
    pieces, codes, starts, ends = distinct_pieces(["" if i in whole else t for i, t in enumerate(texts)])
    heads, head = np.unique(codes[starts], return_inverse=True)
    further = np.ones(len(codes), bool)
    further[starts] = False
    rest = np.flatnonzero(np.bincount(codes[further], minlength=len(pieces)))
    strings = lambda places: pieces.take(pa.array(places)).to_numpy(zero_copy_only=False).tolist()
    known = _encoded(tokenizer, first, strings(heads), "", CACHE_UNITS // 4) + _encoded(tokenizer, later, strings(rest), " ", CACHE_UNITS)
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    place = np.zeros(len(pieces), np.int64)
    place[rest] = np.arange(len(heads), len(known))
    unit = place[codes]
    unit[starts] = head
    n = sizes[unit]
    stop = np.cumsum(n)
    at = stop - n
    source = np.repeat((np.cumsum(sizes) - sizes)[unit] - at, n)
    source += np.arange(len(source))
    ids = np.frombuffer(b"".join(known), "<u4")[source]
    out = [ids[a:b].tobytes() for a, b in zip(at[starts], stop[ends - 1])]
    for i in whole:
        out[i] = array("I", tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of a document's chunks."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    run = np.cumsum(mixed, dtype=np.uint64)  # the hash of a window is the sum of its mixed ids
    rolling = run[_WINDOW - 1 :].copy()
    rolling[1:] -= run[:-_WINDOW]
    rolling = (rolling * _MULTIPLIER) >> np.uint64(40)
    marks = np.flatnonzero(rolling % np.uint64(MEAN_IDS) == 0) + _WINDOW
    ends, at = [], 0
    while n - at > MIN_IDS:
        k = np.searchsorted(marks, at + MIN_IDS)
        end = min(int(marks[k]) if k < len(marks) else n, at + MAX_IDS, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def merkle_root(addresses: list[bytes]) -> bytes:
    """Root over leaves in order; an odd node moves up as it is; no leaf gives 32 zero bytes."""
    level = addresses or [bytes(32)]
    while len(level) > 1:
        level = [sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _objects(batches, path: str):
    """Chunk rows, each address once a batch, and a recipe row for each document."""
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    for b in batches:
        texts, doc_ids = b["text"].tolist(), b["doc_id"].tolist()
        seen: set[bytes] = set()
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                size += len(texts[end])
                end += 1
            chunks, recipes = [], []
            for doc_id, raw in zip(doc_ids[at:end], encode_texts(texts[at:end], path)):
                ids = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(END_ID)).astype("<u4")
                addresses, start = [], 0
                for stop in cut_points(ids):
                    payload = ids[start:stop]
                    payload = (payload.astype("<u2") if payload.max() < 65536 else payload).tobytes()
                    payload = bytes([len(payload) // (stop - start)]) + payload
                    address = sha256(payload).digest()
                    if address not in seen:
                        seen.add(address)
                        chunks.append(("chunk", address, None, None, payload))
                    addresses.append(address)
                    start = stop
                recipes.append(("recipe", f"{part}:{row}".encode(), doc_id, len(ids), b"".join(addresses)))
                row += 1
            out = pd.DataFrame(chunks + recipes, columns=["kind", "key", "doc_id", "n_tokens", "payload"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["n_tokens"] = out["n_tokens"].astype("Int64")
            yield out
            at = end


def write_store(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode every whole text, append the end id, and write the store.

    One shuffle moves each chunk to its address's partition, where all but one
    copy goes; a batch sends a chunk once, however many of its documents hold it.
    """
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(lambda b: _objects(b, tokenizer_path), _OBJECT)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded.repartition(n, "kind", "key").sortWithinPartitions("kind", "key").dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{path}/objects")

    recipes = _read(spark, path, "recipe")
    ordered = recipes.select("doc_id", "n_tokens", F.col("payload").alias("addresses"))
    (
        ordered.repartitionByRange(max(1, n // 4), "doc_id", "addresses")
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("part", "doc_id", "addresses")
        .write.parquet(f"{path}/ordered")
    )
    ordered = spark.read.parquet(f"{path}/ordered")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    sums = sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("doc_id", "addresses").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(F.broadcast(sums), "part").withColumn(
        "start", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )

    def rooted(batches):
        for b in batches:
            b["root"] = [merkle_root([a[i : i + 32] for i in range(0, len(a), 32)]) for a in b["addresses"]]
            yield b[["part", "doc_id", "start", "n_tokens", "addresses", "root"]]

    placed.select("part", "doc_id", "start", "n_tokens", "addresses").mapInPandas(
        rooted, "part int, doc_id long, start long, n_tokens long, addresses binary, root binary"
    ).write.parquet(f"{path}/recipes")

    written = spark.read.parquet(f"{path}/recipes")

    def slice_root(batches):
        leaves: dict[int, list] = {}
        for b in batches:
            for part, start, root in zip(b["part"], b["start"], b["root"]):
                node = leaves.setdefault(part, [start, 0, sha256()])
                node[1] += 1
                node[2].update(root)
        yield pd.DataFrame([(p, s, n, h.digest()) for p, (s, n, h) in leaves.items()], columns=["part", "start", "n_docs", "root"])

    written.select("part", "start", "root").repartition(max(1, n // 4), "part").sortWithinPartitions("part", "start").mapInPandas(
        slice_root, "part int, start long, n_docs long, root binary"
    ).coalesce(1).write.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECT).parquet(f"{path}/objects").where(F.col("kind") == kind)


def store_root(spark: SparkSession, path: str) -> str:
    """Hexadecimal Merkle root of a store, from its manifest (one row for each slice)."""
    rows = spark.read.parquet(f"{path}/manifest").orderBy("start", "part").collect()
    return merkle_root([bytes(r["root"]) for r in rows]).hex()


def _ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype="<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def _times(matrix, bits: int) -> int:
    out = at = 0
    while bits:
        if bits & 1:
            out ^= matrix[at]
        bits >>= 1
        at += 1
    return out


def _crc_table() -> list[list[int]]:
    """Row k: what 2**k zero bytes after it do to each bit of a crc."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    rows = []
    for k in range(48 + 3):
        if k >= 3:
            rows.append(step)
        step = [_times(step, s) for s in step]
    return rows


def _byte_tables() -> np.ndarray:
    """At k, byte, value: what 2**k zero bytes after it do to a crc that holds this byte alone."""
    rows, values = np.array(_crc_table(), np.uint32), np.arange(256)
    out = np.zeros((len(rows), 4, 256), np.uint32)
    for bit in range(32):
        out[:, bit // 8, values >> bit % 8 & 1 == 1] ^= rows[:, bit, None]
    return out


_SHIFTS = _byte_tables()


def join_crcs(crcs: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of each run of parts (from one of ``starts`` to the next) from those of its parts and their numbers of bytes.

    A part's crc counts as if so many zero bytes came after it as the run still has.
    """
    run = np.cumsum(lengths)
    after = np.repeat(run[np.append(starts[1:], len(run)) - 1], np.diff(np.append(starts, len(run)))) - run
    crcs = crcs.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        at = np.flatnonzero(after >> k & 1)
        x, table = crcs[at], _SHIFTS[k]
        crcs[at] = table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]
    return np.bitwise_xor.reduceat(crcs, starts)


def crc_join(first: int, second: int, length: int) -> int:
    """crc32 of a + b from crc32(a), crc32(b) and the number of bytes of b."""
    return int(join_crcs(np.array([first, second]), np.array([0, length]), np.array([0]))[0])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, root of every stored document, from the files.

    Chunks are read and checked where they lie; only their address, length and
    checksum travel to the recipes that name them.
    """

    def facts(batches):
        for b in batches:
            rows = []
            for address, payload in zip(b["key"], b["payload"]):
                if sha256(payload).digest() != address:
                    raise ValueError(f"chunk {address.hex()} doesn't match its address")
                ids = _ids(payload)
                rows.append((address, len(ids), zlib.crc32(ids.tobytes())))
            yield pd.DataFrame(rows, columns=["address", "n_ids", "crc"])

    chunks = _read(spark, path, "chunk").select("key", "payload")
    chunks = chunks.mapInPandas(facts, "address binary, n_ids long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes").drop("part")
    places = F.transform(F.sequence(F.lit(0), (F.length("addresses") / 32).cast("int") - 1), lambda i: F.substring(F.col("addresses"), i * 32 + 1, F.lit(32)))
    named = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode(places).alias("seq", "address"))
    found = named.join(chunks, "address", "left")

    def whole(batches):
        for b in batches:
            if not len(b):
                continue
            starts, crcs, lengths = [], [], []
            for doc_id, n_tokens, root, parts in zip(b["doc_id"], b["n_tokens"], b["root"], b["parts"]):
                parts = sorted(((p["seq"], p["address"], p["n_ids"], p["crc"]) for p in parts), key=itemgetter(0))
                starts.append(len(crcs))
                for _, address, n_ids, crc in parts:
                    if crc is None:
                        raise ValueError(f"chunk {address.hex()} is missing")
                    crcs.append(crc)
                    lengths.append(4 * n_ids)
                if merkle_root([p[1] for p in parts]) != root or sum(p[2] for p in parts) != n_tokens:
                    raise ValueError(f"document {doc_id} doesn't match its recipe")
            out = b[["doc_id", "start", "n_tokens"]].astype({"doc_id": "Int64"})
            out["ids_crc32"] = join_crcs(np.array(crcs), np.array(lengths, np.int64), np.array(starts)).astype(np.int64)
            out["root"] = [r.hex() for r in b["root"]]
            yield out

    return (
        found.groupBy("doc_id", "start", "n_tokens", "root")
        .agg(F.collect_list(F.struct("seq", "address", "n_ids", "crc")).alias("parts"))  # one document's chunks
        .mapInPandas(whole, "doc_id long, start long, n_tokens long, ids_crc32 long, root string")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, token_ids (with the end id) rebuilt from the store."""

    def joined(batches):
        for b in batches:
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "start": b["start"], "token_ids": [np.concatenate([_ids(p["payload"]) for p in sorted(parts, key=lambda p: p["seq"])]) for parts in b["parts"]]}
            )

    chunks = _read(spark, path, "chunk").select("key", "payload").withColumnRenamed("key", "address")
    recipes = spark.read.parquet(f"{path}/recipes")
    places = F.transform(F.sequence(F.lit(0), (F.length("addresses") / 32).cast("int") - 1), lambda i: F.substring(F.col("addresses"), i * 32 + 1, F.lit(32)))
    named = recipes.select("doc_id", "start", F.posexplode(places).alias("seq", "address"))
    parts = named.join(chunks, "address").groupBy("doc_id", "start").agg(F.collect_list(F.struct("seq", "payload")).alias("parts"))
    return parts.mapInPandas(joined, "doc_id long, start long, token_ids array<long>")
