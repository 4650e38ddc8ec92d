"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed character n-grams; a
linear softmax over that average gives the language.  Embeddings and softmax
are trained together by stochastic gradient descent in numpy on the driver, on
at most ``sample`` labelled documents, chosen over all of them by the hash of
their id.  A fifth of the sample is kept from training to fit the softmax
temperature and the score below which a prediction is rejected: the quantile
1 - ``KEEP`` of its correct predictions' scores, without a floor or a cap.

Results for unusual input: a null text, or one without a letter, is ``und`` with
score 0; without any labelled document every text is ``und``; documents with a
null doc_id or lang are never learned from; repeated rows are judged row by
row; a very long text counts as a whole, and a tie goes to the first language by
name; an empty table gives an empty result.  Extra columns are ignored, or kept
by ``keep_identified`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, split_by_bytes

#: Hash buckets of the n-grams, n-gram lengths, size of an embedding.
BUCKETS, LENGTHS, WIDTH = 1 << 15, (2, 3, 4), 16
#: Bound on the labelled documents that a model is fitted on, and on passes over them.
SAMPLE, EPOCHS, RATE = 3000, 4, 0.6
#: Share of correct held-back predictions that rejection must keep.
KEEP = 0.999
#: Characters handled at a time.
SLICE_CHARS = 150_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its text's index, letters of each text).

    Letters are lower-cased; all else counts as one blank, and n-grams don't
    reach over text ends.
    """
    lowered = [t.lower() for t in texts]
    whole = "\n".join(lowered)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[: len(points)]
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()  # one blank of each run that follows a letter stays
    keep[1:] |= letter[:-1]
    points, owner = np.where(letter, points, np.uint32(32))[keep], owner[keep]
    buckets, owners = [], []
    for n in LENGTHS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x01000193, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        one = owner[:m] == owner[n - 1 :]
        buckets.append((h % np.uint32(BUCKETS))[one])
        owners.append(owner[:m][one])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), letters
    return np.concatenate(buckets), np.concatenate(owners), letters


@dataclass(frozen=True)
class LanguageModel:
    """``logits[bucket]`` folds an n-gram's embedding and the softmax weights into one row."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for part in split_by_bytes(texts, SLICE_CHARS):
            buckets, owner, letters = _grams(texts[part])
            n = len(letters)
            count = np.bincount(owner, minlength=n)
            sums = np.stack([np.bincount(owner, weights=column[buckets], minlength=n) for column in self.logits.T], axis=1)
            z = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i in np.flatnonzero(letters > 0):
                names[part.start + i] = self.languages[best[i]]
                scores[part.start + i] = p[i, best[i]]
        return names, scores


def fit(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    """Train on labelled texts."""
    names = tuple(sorted(set(langs)))
    if not names:
        return LanguageModel((), np.zeros((1, 1)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    bags = []
    for text in texts:
        buckets, _, letters = _grams([text])
        ids, counts = np.unique(buckets, return_counts=True)
        bags.append((ids, counts / max(1, counts.sum())) if letters[0] and len(ids) else None)
    y = np.array([names.index(x) for x in langs])
    usable = np.array([i for i, b in enumerate(bags) if b is not None], dtype=int)
    held = usable[::5] if len(usable) >= 50 else usable
    train = np.setdiff1d(usable, held) if len(usable) >= 50 else usable
    embed = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    weights, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    weights += rng.normal(0, 0.1, weights.shape)
    steps, done = EPOCHS * max(1, len(train)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = RATE * (1 - done / steps) + 1e-3
            done += 1
            ids, share = bags[i]
            x = share @ embed[ids]
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(x, p)
            bias -= rate * p
            embed[ids] -= (rate * 50) * share[:, None] * back  # an average spreads the gradient thin
    logits = embed @ weights
    z = np.array([bags[i][1] @ logits[bags[i][0]] + bias for i in held]).reshape(len(held), len(names))

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]))

    temperature = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss) if len(held) else 1.0
    reject = 0.0
    if len(held):
        p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            reject = float(np.quantile(p.max(axis=1)[right], 1 - KEEP))
    return LanguageModel(names, logits.astype(np.float64), bias, temperature, reject)


def is_held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` documents that aren't held out, the first by the hash of their id."""
    known = docs.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64("doc_id")
    first = known.select(place.alias("place")).orderBy("place").limit(sample).collect()  # numbers only
    cut = first[-1]["place"] if first else 0
    rows = known.where(place <= cut).select("doc_id", "text", "lang").orderBy(place, "doc_id", "lang", "text").limit(sample).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _judged(docs: DataFrame, model: LanguageModel):
    """The struct (lang_pred, score, kept) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, kept boolean")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        names, scores = m.predict([t or "" for t in texts.to_pylist()])
        kept = [n != "und" and s >= m.reject_below for n, s in zip(names, scores)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], ["lang_pred", "score", "kept"])

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Append lang_pred, lang_score and lang_kept (the score isn't below the model's limit) to every row; columns of these names are replaced."""
    (name,) = fresh_names(docs, "lang")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_kept")]
    found = docs.withColumn(name, _judged(docs, model))
    return found.select(*own, F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("lang_score"), F.col(name)["kept"].alias("lang_kept"))


def language_of(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, kept of every document."""
    model = learn(docs, sample)
    found = docs.select("doc_id", _judged(docs, model).alias("r"))
    return found.select("doc_id", is_held_out().alias("held_out"), "r.lang_pred", "r.score", "r.kept")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is not rejected, with their own columns, whatever their names."""
    (name,) = fresh_names(docs, "lang")
    found = docs.withColumn(name, _judged(docs, learn(docs, sample)))
    return found.where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
