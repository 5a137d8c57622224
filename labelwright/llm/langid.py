"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is the counts of its hashed 1- to 3-grams of lower-cased characters,
weighted by inverse document frequency and scaled to length 1.  The weights are
learned by follow-the-regularised-leader (FTRL-proximal): per-coordinate steps,
an L1 part that leaves most weights at exactly 0 and an L2 part.  Learn rows set
aside give the temperature by which margins are divided, so that scores are
probabilities.

Document frequencies are counted over all learn rows; ``MAX_ROWS`` bounds the
labelled rows the weights are fitted on, one row per document and language.  Languages take turns in that
sample, so a rare one is learned beside a hot one.  Whole texts are read, long ones in
slices that overlap, so memory per task is bounded.

Results: lang_pred is a learned language, or ``und`` with score 0 for null texts
and texts without a letter, and for every text when nothing was learned.  Null
languages are not learned from.  Ties go to the first language by name.  Extra
columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import one_of_each, packed, spread_sample, texts_of

SIZE = 1 << 14
SLICE = 1 << 18
MAX_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
UNDETERMINED = "und"
_A, _B = np.uint32(2654435761), np.uint32(40503)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a whole text."""
    out = np.zeros(SIZE, np.int64)
    shift = np.uint32(32 - SIZE.bit_length() + 1)
    text = text.lower()
    for at in range(0, len(text), SLICE):
        c = np.frombuffer(text[max(0, at - 2) : at + SLICE].encode("utf-32-le", "replace"), np.uint32)
        skip = min(at, 2)
        one = c * _A
        out += np.bincount(one[skip:] >> shift, minlength=SIZE)
        two = (one[:-1] + c[1:] * _B) * _A
        out += np.bincount(two[max(skip - 1, 0) :] >> shift, minlength=SIZE)
        three = (two[:-1] + c[2:] * _B) * _A
        out += np.bincount(three >> shift, minlength=SIZE)
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the TF-IDF vector, of length 1."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


class Ftrl:
    """Multinomial logistic regression; z and n are the leader's sums per weight."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the margins with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(softmax(margins / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, t: float):
        self.langs, self.idf, self.w, self.t = langs, idf, w, t

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        at, x = weighed(gram_counts(text), self.idf)
        p = softmax((x @ self.w[at]) / self.t)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(rows, idf: np.ndarray) -> Model:
    """``rows``: a pandas frame of doc, lang, at, n (sparse counts)."""
    langs = sorted(set(rows["lang"]))
    if len(langs) == 0:
        return Model([], idf, np.zeros((SIZE, 0)), 1.0)
    label = rows["lang"].map({g: i for i, g in enumerate(langs)}).to_numpy()
    order = sorted(range(len(rows)), key=lambda i: xxhash.xxh64_intdigest(str(rows["doc"].iloc[i])))
    vectors = []
    for at, n in zip(rows["at"], rows["n"]):
        at = np.asarray(at, np.int64)
        x = np.log1p(np.asarray(n, float)) * idf[at]
        vectors.append((at, x / max(np.linalg.norm(x), 1e-12)))
    aside = order[::5] if len(order) >= 50 else order
    learn = [i for k, i in enumerate(order) if k % 5] if len(order) >= 50 else order
    model = Ftrl(len(langs))
    for _ in range(EPOCHS):
        for i in learn:
            model.learn(*vectors[i], label[i])
    w = model.weights()
    margins = np.stack([vectors[i][1] @ w[vectors[i][0]] for i in aside])
    return Model(langs, idf, w, temperature(margins, label[aside]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learn from all rows of ``docs`` with a language: frequencies from all, weights from at most ``max_rows``."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("doc"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for text in texts_of(b.column(0)):
                seen += gram_counts(text) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["at", "n"])

    sums = {r["at"]: r["n"] for r in rows.select("text").mapInArrow(held, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    total = sums.pop(-1, 0)
    idf = np.full(SIZE, np.log(1.0 + total) + 1)
    for at, n in sums.items():
        idf[at] = np.log((1 + total) / (1 + n)) + 1
    chosen = spread_sample(rows.where(F.col("doc").isNotNull()).select("doc", "lang").distinct(), max_rows, "lang", "doc", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for text in texts_of(b.column(2)):
                grams = gram_counts(text)
                at.append(np.flatnonzero(grams))
                n.append(grams[at[-1]])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, lists), pa.array(n, lists)], ["doc", "lang", "at", "n"])

    # At most max_rows rows of names: a broadcast of proven size.
    got = one_of_each(rows.join(F.broadcast(chosen), ["doc", "lang"]).select("doc", "lang", "text"), "doc", "lang").mapInArrow(
        counted, "doc string, lang string, at array<long>, n array<long>")
    return fit(got.toPandas(), idf)


def prediction(model: Model, text: Column) -> Column:
    """struct (lang, score) as a column."""
    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(t) for t in texts_of(texts)]
            yield pa.StructArray.from_arrays(
                [pa.array([g for g, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    return predict(text)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, found): every column of ``docs`` in ``row``, and struct (lang, score)."""
    return packed(docs, found=prediction(model, F.col(f"`{text_col}`")))
