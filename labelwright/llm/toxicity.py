"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are learned from.  The risk
of a classifier g is estimated without negatives: with pi the share of toxic
documents,

    pi E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi E_P[l(g, -1)])

and where the bracket turns negative (the classifier begins to learn single
unlabelled documents) the step goes the other way.  A few numpy classifiers,
each with its own half of the unlabelled rows, are averaged.

Features are the presence of words and of word beginnings (3 to 7 bytes, for
words that vary in their ending); those that toxic texts have clearly oftener
and that make a text toxic with some likelihood, pi P(f | toxic) / P(f), are kept.
Where the labels are richer in toxic texts than the unlabelled rows, that ratio is far above 1
for the purest features: it has no upper bound.  ``MAX_TOXIC`` and ``MAX_UNLABELLED`` bound the
rows for fitting, ``MAX_FEATURES`` the model; all whole texts are scored, where
they lie.

Results: score is between 0 and 1 for every row, null and empty texts included
(they get the score of a text without any feature).  Without confirmed toxic
rows the score is 0.  Null labels are ignored; a document with several labels is
toxic if one says so.  Extra columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import bounded_sample, one_of_each, packed, texts_of

MAX_TOXIC = 3000
MAX_UNLABELLED = 6000
MAX_FEATURES = 512
SLOTS = 1 << 22
MIN_DOCUMENTS = 3
MIN_Z = 3.0
LIKELIHOOD = 0.4
PREFIXES = (3, 4, 5, 6, 7)
CLASSIFIERS = 3
STEPS = 200
RATE = 0.05
RIDGE = 2e-4
DEFAULT_PRIOR = 0.1
_GAPS = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words of a whole text, lower-cased."""
    return set(text.lower().encode().translate(_GAPS).split()) if text else set()


def features_of(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings; a beginning is marked so that it differs from the word it equals."""
    names = [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh64_intdigest(x) & (SLOTS - 1) for x in names]


class Weights(dict):
    """Per word, the selected features it has; recently seen words are remembered."""

    LIMIT = 1 << 16

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return got

    def present(self, text: str | None) -> list[int]:
        return sorted({k for w in words_of(text) for k in self[w]})


class PositiveUnlabelled:
    """Linear classifier fitted by the non-negative risk, with Adam; equal rows are one row with a weight."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float):
        (p, share_p), (u, share_u) = _merged(positive), _merged(unlabelled)
        n = p.shape[1]
        w, bias = np.zeros(n), np.log(prior / (1 - prior))
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        for step in range(1, STEPS + 1):
            w32 = w.astype(np.float32)
            mp, mu = p @ w32 + bias, u @ w32 + bias
            # The slope of l(g, +1) is s(g) - 1, that of l(g, -1) is s(g).
            toxic_as_toxic = prior * _slope(p, share_p * (_sigmoid(mp) - 1))
            rest_as_clean = _slope(u, share_u * _sigmoid(mu)) - prior * _slope(p, share_p * _sigmoid(mp))
            risk = share_u @ np.logaddexp(0, mu) - prior * (share_p @ np.logaddexp(0, mp))
            grad = toxic_as_toxic + rest_as_clean if risk >= 0 else -rest_as_clean
            grad[:n] += RIDGE * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:n], bias - move[n]
        self.w, self.bias = w, bias


def _merged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, n = np.unique(np.packbits(x > 0, axis=1), axis=0, return_counts=True)
    return np.unpackbits(rows, axis=1, count=x.shape[1]).astype(np.float32), n / n.sum()


def _slope(x: np.ndarray, each: np.ndarray) -> np.ndarray:
    return np.append(each.astype(np.float32) @ x, each.sum())


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


class Model:
    """Selected features and the averaged classifiers."""

    def __init__(self, index: dict[int, int], parts: list[PositiveUnlabelled]):
        self.index = index
        self.w = np.stack([p.w for p in parts]) if parts else np.zeros((1, len(index)))
        self.bias = np.array([p.bias for p in parts]) if parts else np.full(1, -30.0)

    def score(self, texts: Iterable[str | None], seen: Weights) -> list[float]:
        return [float(_sigmoid(self.w[:, seen.present(t)].sum(axis=1) + self.bias).mean()) for t in texts]


def select_features(rows, prior: float) -> dict[int, int]:
    """The features whose share of toxic rows exceeds that of unlabelled rows most clearly."""
    counts = np.zeros((2, SLOTS), np.int32)
    for text, toxic in zip(rows["text"], rows["toxic"]):
        counts[toxic, np.unique(np.array([f for w in words_of(text) for f in features_of(w)], np.int64))] += 1
    names = np.flatnonzero(counts.sum(axis=0) >= MIN_DOCUMENTS)
    u, p = counts[:, names].astype(float)
    nu, np_ = max((rows["toxic"] == 0).sum(), 1), max((rows["toxic"] == 1).sum(), 1)
    pooled = (u + p) / (nu + np_)
    z = (p / np_ - u / nu) / np.sqrt(pooled * (1 - pooled) * (1 / nu + 1 / np_) + 1e-12)
    likely = prior * (p / np_) / np.maximum(u / nu, 1e-9)
    fit = np.flatnonzero((z >= MIN_Z) & (likely >= LIKELIHOOD))
    best = fit[np.argsort(-z[fit], kind="stable")[:MAX_FEATURES]]
    return {int(names[k]): i for i, k in enumerate(best)}


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Fit on the toxic rows of ``labels`` and on documents without any label."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(
        F.col(f"`{id_col}`").alias("doc")).agg(F.max(label_col).cast("int").alias("y"))
    ids = docs.select(F.col(f"`{id_col}`").alias("doc")).where(F.col("doc").isNotNull()).distinct()
    unmarked = ids.join(marked.select("doc"), "doc", "left_anti")
    prior = marked.agg(F.avg("y")).head()[0]
    chosen = bounded_sample(marked.where("y = 1"), max_toxic, "doc").select("doc", F.lit(1).alias("toxic")).union(
        bounded_sample(unmarked, max_unlabelled, "doc").select("doc", F.lit(0).alias("toxic")))
    text = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only distinct words matter: the rest of a text need not travel.
        for b in batches:
            words = [" ".join(w.decode(errors="replace") for w in sorted(words_of(t))) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), b.column(2)], ["doc", "text", "toxic"])

    # At most max_toxic + max_unlabelled ids: a broadcast of proven size.
    one = one_of_each(text.join(F.broadcast(chosen), "doc"), "doc", "toxic")
    got = one.select(F.col("doc").cast("string").alias("doc"), "text", "toxic").mapInArrow(shortened, "doc string, text string, toxic int")
    return fit(got.toPandas(), DEFAULT_PRIOR if prior is None else prior)


def fit(rows, prior: float) -> Model:
    """``rows``: a pandas frame of doc, text (its distinct words will do) and toxic (0: unlabelled)."""
    rows = rows.sort_values(["toxic", "doc"], kind="stable")
    if not (rows["toxic"] == 1).any():
        return Model({}, [])
    prior = float(np.clip(prior, 0.01, 0.9))
    index = select_features(rows, prior)
    seen = Weights(index)
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, text in enumerate(rows["text"]):
        x[i, seen.present(text)] = 1
    y = rows["toxic"].to_numpy()
    positive, unlabelled = x[y == 1], x[y == 0]
    if not len(unlabelled):
        unlabelled = np.zeros((1, len(index)), np.float32)
    draws = [xxhash.xxh32_intdigest(f"{i}") for i in range(len(unlabelled))]
    parts = []
    for k in range(CLASSIFIERS):
        half = np.array([(d + k) % CLASSIFIERS != 0 for d in draws])
        parts.append(PositiveUnlabelled(positive, unlabelled[half] if half.any() else unlabelled, prior))
    return Model(index, parts)


def toxicity_score(model: Model, text: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = Weights(model.index)
        for texts in batches:
            yield pa.array(model.score(texts_of(texts), seen), pa.float64())

    return score(text)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): every column of ``docs`` in ``row``."""
    return packed(docs, score=toxicity_score(model, F.col(f"`{text_col}`")))
