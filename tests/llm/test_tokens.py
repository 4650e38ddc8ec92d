"""BPE and the token store against the tokenizers library."""

import random
import zlib
from array import array
from hashlib import sha256

import numpy as np

from tidemark.llm import bpe, token_store
from tidemark.llm.common import scratch_path
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.units import distinct_pieces, split_units

SPACES = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2009\u3000\u200b\u180e abcé'sll1²½٣٤中文🎉$!.́\ufeff\x00"


def odd_texts(n=3000):
    r = random.Random(1)
    texts = ["".join(r.choice(SPACES) for _ in range(r.randint(0, 14))) for _ in range(n)]
    return texts + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 5000, "Hent " * 3000, "", "'", "don't 'll", "word,, word.", "a  b", " a", "a "]


def test_codec_is_the_library(tokenizer, sample):
    path = tokenizer_path()
    texts = odd_texts() + sample[:60]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        back = tokenizer.decode(e.ids, skip_special_tokens=False)
        assert bpe.codec(path).encode(t) == e.ids
        assert bpe.codec(path).decode(e.ids) == back
        assert bpe.text_digest(t, path) == (len(e.ids), sha256(",".join(map(str, e.ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest())


def test_small_caches_change_nothing(tokenizer, sample, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_UNITS", 5)
    bpe._remembered.cache_clear()
    monkeypatch.setattr(token_store, "CACHE_UNITS", 5)
    token_store._library.cache_clear()
    path = tokenizer_path()
    for t, raw in zip(sample[:20], token_store.encode_texts(sample[:20], path)):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.text_digest(t, path)[0] == len(ids) and np.frombuffer(raw, "<u4").tolist() == ids
    bpe._remembered.cache_clear()
    token_store._library.cache_clear()


def test_batch_encoding_is_the_library(tokenizer):
    texts = odd_texts()
    for raw, e in zip(token_store.encode_texts(texts, tokenizer_path()), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids


def test_columns(spark, documents, tokenizer):
    docs = documents([None, "", "Hello there"])
    out = bpe.decode_documents(bpe.encode_documents(docs, tokenizer_path()), tokenizer_path()).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["", "", "Hello there"] and out[2]["token_ids"] == tokenizer.encode("Hello there", add_special_tokens=False).ids


def store(spark, docs):
    path = scratch_path(spark, "test")
    token_store.write_store(docs, tokenizer_path(), path)
    return path


def test_store_round_trip(spark, documents, tokenizer, sample):
    texts = [None, "", *sample[:80], sample[3], sample[3], "<|endoftext|>x"]
    path = store(spark, documents(texts))
    at, expected = 0, {}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        expected[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    got = {r["doc_id"]: r for r in token_store.read_checksums(spark, path).collect()}
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: e[:3] for i, e in expected.items()}
    back = {r["doc_id"]: (r["start"], r["token_ids"]) for r in token_store.read_documents(spark, path).collect()}
    assert back == {i: (e[0], e[3]) for i, e in expected.items()}
    objects = spark.read.parquet(f"{path}/objects")
    chunks = objects.where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert len(token_store.store_root(spark, path)) == 64


def test_store_of_nothing_and_of_odd_ids(spark, documents):
    assert token_store.read_checksums(spark, store(spark, documents([]))).count() == 0
    rows = token_store.read_checksums(spark, store(spark, documents(["a", "b", "a"], [5, None, 5]))).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 5, 5] and [r["start"] for r in rows] == [0, 2, 4]


def test_cut_points_follow_content():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 50000, 9000).astype("<u4"), r.integers(0, 50000, 700).astype("<u4")
    ends = token_store.cut_points(a)
    assert ends[-1] == len(a) and all(x <= token_store.MAX_IDS for x in np.diff([0, *ends]))
    moved = [e - 700 for e in token_store.cut_points(np.concatenate((b, a))) if e > 700]
    assert len(set(moved) & set(ends)) >= len(ends) // 2


def test_crc_join():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc", b"defgh" * 999)):
        assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_units_of_odd_texts_are_the_library(tokenizer):
    """Words go to the library's model by themselves; what joins them must not change their ids."""
    rnd = random.Random(5)
    pieces = ["a", "B", "é", "ß", " ", "  ", "\n", ".", "'", "'s", "9", "_", "ñ", "\t", "\xa0", "你", "😀", "ɏ", "ə", "\u0301", "!?", "\r"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    texts += ["x.\nAning it's Don't.\nIt'll a.\n\nb a. \nb", " .\na", "a.\nb c,\nd", "<|endoftext|> a"]
    for raw, e in zip(token_store.encode_texts(texts, tokenizer_path()), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert raw == array("I", e.ids).tobytes()


def test_checksums_of_runs_join(monkeypatch):
    r = random.Random(11)
    runs = [[r.randbytes(r.choice([0, 1, 4, 1024, 5000, 70_000])) for _ in range(r.randint(1, 6))] for _ in range(60)]
    parts = [p for run in runs for p in run]
    starts = np.cumsum([0, *map(len, runs)])[:-1]
    got = token_store.join_crcs(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), starts)
    assert got.tolist() == [zlib.crc32(b"".join(run)) for run in runs]


def test_full_memory_keeps_what_is_needed_now(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_UNITS", 40)
    token_store._library.cache_clear()
    texts = [" ".join(["a", *(f"often{chr(97 + i)}" for i in range(10)), *(f"once{chr(97 + k)}{chr(97 + i)}" for i in range(12))]) for k in range(8)]
    seen, word = [], token_store.array
    monkeypatch.setattr(token_store, "array", lambda kind, ids: seen.append(tuple(ids)) or word(kind, ids))
    for t in texts:
        assert np.frombuffer(token_store.encode_texts([t], tokenizer_path())[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    token_store._library.cache_clear()
    assert seen.count(tuple(tokenizer.encode(" oftena", add_special_tokens=False).ids)) == 1


def test_a_call_looks_up_each_word_once(tokenizer, monkeypatch):
    class Counted(dict):
        asked = 0

        def __getitem__(self, unit):
            Counted.asked += 1
            return super().__getitem__(unit)

    texts = ["The tide, rose and the tide. fell " * 300 + "ende", "Ebb\n and  flow", "", "tide, tide,\ntide ñu, x1"]
    monkeypatch.setattr(token_store, "_library", lambda path: (tokenizer, Counted(), Counted(), ["<|endoftext|>"]))
    for raw, e in zip(token_store.encode_texts(texts, tokenizer_path()), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(raw, "<u4").tolist() == e.ids
    assert 0 < Counted.asked < 100  # of 2100 units


def test_pieces_are_those_of_split_units():
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "bc", " ", " ", "  ", "\n", ".", "\t", "é"]) for _ in range(r.randrange(12))) for _ in range(500)] + ["", " "]
    pieces, codes, starts, ends = distinct_pieces(texts)
    names = pieces.to_pylist()
    assert len(set(names)) == len(names)
    assert [[names[c] for c in codes[a:b]] for a, b in zip(starts, ends)] == [split_units(t) for t in texts]
