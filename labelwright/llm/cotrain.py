"""Document quality by co-training of a text view and a metadata view.

Two logistic classifiers see different columns: one the shape of the whole text
(case, symbols, repetition, lines), the other the page's metadata (source,
language, stated length).  Over some rounds each labels the unlabelled documents
it is surest of, and these pseudo-labels train the *other* view.  Labelled
documents set aside before the first round then calibrate each view (Platt
scaling) and weigh the two against each other; the combination scores all
documents in one pass without a shuffle.

``MAX_LABELLED`` and ``MAX_UNLABELLED`` bound the rows the models are fitted on.

Results: score is the probability that a document is good.  Null and empty texts
get a score like any other.  Without labels of both kinds nothing can be told
apart: every score is 1 and every document stays.  Null labels are ignored; of
repeated labels of a document the greatest counts.  Missing metadata columns
and lengths that are no number count as null.  Extra columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import WordHashes, bounded_sample, gram_hashes, one_of_each, packed, texts_of, unpacked

MAX_LABELLED = 20_000
MAX_UNLABELLED = 10_000
EXCHANGE_ROUNDS = 4
EXCHANGED = 400
SURE = 0.9
KEEP_FROM = 0.5
META = ("source", "lang", "n_chars")
BUCKETS = 64
SYMBOLS = b"#*$%&|<>"
STOPS = b".!?"


def text_features(text: str | None, cache: WordHashes) -> np.ndarray:
    """Shape of a whole text: shares of kinds of bytes, of repetition, and sizes."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    hashes = cache.of(words)
    upper, low = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum() / 2
    lines = data.split(b"\n")
    grams = gram_hashes(hashes, 3)
    of = lambda chars: sum(counts[c] for c in chars)
    share = [
        upper / max(upper + low, 1), of(SYMBOLS) / n, of(b"!") / n, of(b"|") / n, of(b"#*$%&") / n, of(b".") / n, of(b",") / n,
        counts[48:58].sum() / size, counts[10] / n, (upper + low) / size,
        (hashes[1:] == hashes[:-1]).sum() / n, 1 - len(np.unique(hashes)) / n, 1 - len(np.unique(grams)) / max(len(grams), 1),
        1 - len(set(lines)) / len(lines),
    ]
    return np.array([*np.sqrt(share), np.log1p(len(words)), np.log1p(size / n), np.log1p(len(lines))], np.float64)


def meta_features(source: object, lang: object, n_chars: object) -> np.ndarray:
    """Hashed names and the logarithm of the stated length."""
    out = np.zeros(2 * BUCKETS + 3)
    for i, name in enumerate((source, lang)):
        out[i * BUCKETS + xxhash.xxh32_intdigest("" if name is None else str(name)) % BUCKETS] = 1
    length = 0.0 if n_chars is None or n_chars != n_chars else float(n_chars)
    out[-3:] = length > 0, np.log1p(max(length, 0)), np.log1p(max(length, 0)) ** 2 / 10
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, ridge: float = 1.0, steps: int = 12):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-3
        w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        self.w = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


class CoTrained:
    """Both views, their calibration and their combination."""

    def __init__(self, x_text: np.ndarray, x_meta: np.ndarray, y: np.ndarray, held: np.ndarray,
                 rounds: int = EXCHANGE_ROUNDS, exchanged: int = EXCHANGED):
        """``y``: 1 good, 0 bad, -1 unlabelled; ``held``: labelled rows kept for calibration."""
        views = [x_text, x_meta]
        known, free = np.flatnonzero((y >= 0) & ~held), np.flatnonzero(y < 0)
        taught = [dict(zip(known, y[known])), dict(zip(known, y[known]))]
        for turn in range(rounds + 1):
            models = []
            for v in (0, 1):
                rows = np.fromiter(taught[v], np.int64)
                models.append(Logistic().fit(views[v][rows], np.array([taught[v][r] for r in rows], float)))
            if turn == rounds or not len(free):
                break
            good = y[known].mean()
            for v in (0, 1):
                other = taught[1 - v]
                open_ = np.array([r for r in free if r not in other], np.int64)
                if not len(open_):
                    continue
                p = sigmoid(models[v].margin(views[v][open_]))
                # Surest first, in the proportion of the labels, and only beyond the bar of sureness.
                for label, sure, share in ((1, p, good), (0, 1 - p, 1 - good)):
                    best = np.argsort(-sure, kind="stable")[: max(1, round(exchanged * share))]
                    other.update((int(open_[k]), label) for k in best if sure[k] >= SURE)
        self.models = models
        own = np.flatnonzero(held & (y >= 0))
        target = y[own].astype(float)
        self.platt = [
            Logistic(1e-2).fit(m.margin(x[own])[:, None], target) for m, x in zip(models, views)]
        self.mix = Logistic(1e-1).fit(self._calibrated([x[own] for x in views]), target)

    def _calibrated(self, views: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.clip(c.margin(m.margin(x)[:, None]), -12, 12) for c, m, x in zip(self.platt, self.models, views)])

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        return sigmoid(self.mix.margin(self._calibrated([x_text, x_meta])))


def _meta_columns(docs: DataFrame) -> list[Column]:
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).try_cast("double" if c == "n_chars" else "string").alias(c) for c in META]


def _views(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return (np.stack([text_features(t, cache) for t in texts_of(text)]),
            np.stack([meta_features(*m) for m in zip(*(x.to_pylist() for x in (source, lang, n_chars)))]))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED,
) -> CoTrained | None:
    """The model, or None where the labels hold fewer than two kinds."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc")).agg(
        F.max(label_col).cast("int").alias("y")).where(F.col("doc").isNotNull())
    ids = docs.select(F.col(f"`{id_col}`").alias("doc")).where(F.col("doc").isNotNull())
    unmarked = ids.join(marked, "doc", "left_anti").distinct()
    chosen = bounded_sample(marked, max_labelled, "doc").union(
        bounded_sample(unmarked, max_unlabelled, "doc").select("doc", F.lit(-1).alias("y")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), *_meta_columns(docs))
    # The chosen ids are at most max_labelled + max_unlabelled rows: a broadcast of proven size.
    rows = one_of_each(rows.join(F.broadcast(chosen), "doc"), "doc", "y")
    kind = "doc string, y int, view_text array<float>, view_meta array<float>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            if batch.num_rows:
                views = _views(*(batch.column(c) for c in ("text", *META)), cache)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("y"), *(pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())) for v in views)],
                    ["doc", "y", "view_text", "view_meta"])

    rows = rows.withColumn("doc", F.col("doc").cast("string"))
    # Flat arrays, never a Python object per row: the driver holds a few tens of megabytes.
    got = rows.mapInArrow(features, kind).toArrow().sort_by("doc").combine_chunks()
    y = got["y"].to_numpy()
    if not {0, 1} <= set(y.tolist()):
        return None
    held = np.array([xxhash.xxh32_intdigest(d) % 4 == 0 for d in got["doc"].to_pylist()])
    a, b = (got[c].combine_chunks().flatten().to_numpy().reshape(len(y), -1) for c in ("view_text", "view_meta"))
    if any(not {0, 1} <= set(y[part & (y >= 0)].tolist()) for part in (held, ~held)):
        return _small(a, b, y)
    return CoTrained(a, b, y, held)


def _small(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> CoTrained:
    """Too few labels to set some aside: the same rows train and calibrate."""
    twice = np.concatenate([y, y[y >= 0]])
    held = np.arange(len(twice)) >= len(y)
    return CoTrained(np.concatenate([a, a[y >= 0]]), np.concatenate([b, b[y >= 0]]), twice, held)


def quality_score(model: CoTrained | None, text: Column, meta: list[Column]) -> Column:
    """Probability that a document is good, as a column."""
    if model is None:
        return F.lit(1.0)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for batch in batches:
            yield pa.array(model.score(*_views(*batch, cache)) if len(batch[0]) else [], pa.float64())

    return score(text, *meta)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **bounds) -> DataFrame:
    """(row, score): every column of ``docs`` in ``row``."""
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    return packed(docs, score=quality_score(model, F.col(f"`{text_col}`"), _meta_columns(docs)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM, **options) -> DataFrame:
    """The documents scored good, all columns as they were."""
    return unpacked(scored(docs, labels, **options).where(F.col("score") >= threshold))
