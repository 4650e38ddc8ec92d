import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # for oracle.py

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, tiles int, h string"


@pytest.fixture(scope="session")
def documents(spark):
    """A table with extra columns of clashing names."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or [None] * len(texts)
        rows = [(i, t, g, "s", None if t is None else len(t), "x", 1, "h") for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [r["text"] for r in rows]


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    from tidemark.llm.queries import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())
