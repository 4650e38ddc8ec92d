"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a pre-token in a doubly linked list and the
possible merges in a priority queue ordered by merge rank, then position.  A
queue entry whose symbols have changed since it was pushed is stale and is
skipped.  Decoding concatenates vocabulary strings and maps them back to bytes.

Results for unusual input: a null text counts as empty; an empty text has no
ids and decodes to the empty string; the text of an added token (such as
``<|endoftext|>``) becomes that token's id, as in the tokenizers library;
repeated rows are encoded row by row; a very long text is encoded as a whole, in
time about its length; of merges of one rank the leftmost comes first; an empty
table gives an empty result.  Extra columns are ignored by ``bpe_digests`` and
kept by the others, which replace a column of the name they write.
"""

from __future__ import annotations

import json
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .units import UnitCache, split_units

#: The byte-level pre-token pattern of this tokenizer family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct units that one Python worker remembers (some 230 bytes each); it lives on after the task.
CACHE_UNITS = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary strings.

    Printable Latin-1 bytes stand for themselves; the others follow from 256 on.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder built from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self._byte_ids = [vocab.get(c) for c in alphabet]
        #: (left id, right id) -> rank, and by rank: left id, right id, joined id.
        self._ranks: dict[tuple[int, int], int] = {}
        self._by_rank: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks[vocab[left], vocab[right]] = rank
            self._by_rank.append((vocab[left], vocab[right], vocab[left + right]))
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings.update({i: s.encode() for s, i in added.items()})
        self._added = added
        self._added_at = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._pre_token = regex.compile(PRE_TOKEN)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = list(map(self._byte_ids.__getitem__, word))
        n = len(symbols)
        if n == 1:
            return symbols
        rank_of, by_rank = self._ranks.get, self._by_rank
        # An entry is rank * 2**32 + position of the left symbol.
        queue = [(r << 32) + i for i, r in enumerate(map(rank_of, zip(symbols, symbols[1:]))) if r is not None]
        if not queue:
            return symbols
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            left, right, joined = by_rank[entry >> 32]
            j = following[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of its symbols has been merged since
            symbols[i], symbols[j] = joined, -1
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                r = rank_of((joined, symbols[k]))
                if r is not None:
                    heappush(queue, (r << 32) + i)
            h = before[i]
            if h >= 0:
                r = rank_of((symbols[h], joined))
                if r is not None:
                    heappush(queue, (r << 32) + h)
        return [s for s in symbols if s >= 0]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        ids: list[int] = []
        for word in self._pre_token.findall(text):
            ids += self.merge(word.encode("utf-8", "surrogatepass"))
        return ids

    def segments(self, text: str):
        """(is an added token, piece) in order."""
        if self._added_at is None or not self._added_at.search(text):
            yield False, text
            return
        at = 0
        for m in self._added_at.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for added, piece in self.segments(text):
            ids += [self._added[piece]] if added else self.encode_plain(piece)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    """One codec for each Python process and file."""
    return BpeCodec(path)


@lru_cache(maxsize=4)
def _remembered(path: str) -> tuple[UnitCache, UnitCache]:
    """For first units and for those after a blank: (number of ids, decimal ids joined by commas, decoded bytes)."""
    c = codec(path)

    def facts(unit: str):
        ids = c.encode_plain(unit)
        return len(ids), ",".join(map(str, ids)), b"".join(map(c.strings.__getitem__, ids))

    return UnitCache(facts, CACHE_UNITS // 4), UnitCache(lambda piece: facts(" " + piece), CACHE_UNITS)


def text_digest(text: str, path: str) -> tuple[int, str, str]:
    """(number of ids, sha256 of the ids, sha256 of the decoded text)."""
    c, (first, blank) = codec(path), _remembered(path)
    facts = []
    for added, piece in c.segments(text):
        if added:
            i = c._added[piece]
            facts.append((1, str(i), c.strings[i]))
        else:
            head, *rest = split_units(piece)
            facts.append(first[head])
            facts += map(blank.__getitem__, rest)
    counts, shown, raw = zip(*facts)
    decoded = b"".join(raw)
    try:
        decoded.decode("utf-8")
    except UnicodeDecodeError:
        decoded = decoded.decode("utf-8", "replace").encode("utf-8")
    return sum(counts), sha256(",".join(filter(None, shown)).encode()).hexdigest(), sha256(decoded).hexdigest()


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Append the ids of ``text`` as an array column; a column named ``ids`` is replaced, all others stay."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(ids, ids_of(text_or_empty(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Append the text that an array column of ids stands for; null ids give null; a column named ``text`` is replaced."""

    @F.arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if r is None else c.decode(r) for r in rows.to_pylist()], pa.string())

    return docs.withColumn(text, text_of(F.col(ids)))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    One pass without a shuffle: a row's result depends on that row alone, so a
    hot source or a very long text costs only its own length.
    """

    def digest(batches):
        for b in batches:
            counts, ids, decoded = map(list, zip(*[text_digest(t, path) for t in b.column("text").to_pylist()])) if b.num_rows else ([], [], [])
            yield pa.record_batch(
                {"doc_id": b.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
