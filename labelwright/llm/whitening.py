"""Whitening of embeddings by shifted CholeskyQR.

An entry c becomes the whole number floor(64 c) + 1000000; the model is fitted on
the distinct vectors of these numbers, so that copies weigh nothing.  With A the
centred rows of that list:

1. A pass over the rows sums their Gram matrix; the Cholesky factor R of the Gram
   matrix plus a shift s (``11 (nd + d(d + 1)) u |A|^2``: it cannot break down)
   turns A into Q = A / R by triangular solves, inside the tasks of the next pass.
2. The Gram matrix of Q gives the next factor, now with no shift (or, for vectors
   with fewer true dimensions than entries, one of a few units in the last place),
   until Q's Gram matrix is a projection.
3. A = Q R with R the product of all factors.  The singular value decomposition of
   R (d x d, on the driver) gives the components of A; their eigenvalues are the
   squared singular values divided by n.

Only d x d sums leave the tasks, whatever the number of rows; they are added up in
a shuffle keyed by matrix row.  Rows are centred in whole numbers: x - floor(S / n)
is exact, only the last fraction is rounded.

Results: rows whose vector is null, empty, or holds null or non-finite entries are
dropped, and so are entries beyond 2**54, whose whole number is no exact long.  The
length that most distinct vectors have (ties: the longer) is the space; rows of
another length have no place in it and are dropped.  Directions without variance
are no components (a table of one distinct vector has none and gives empty lists);
equal eigenvalues share a space, of which any basis is right.  Repeated rows give
a row each, null ids a null id.  An empty table gives an empty result.  Vectors may
have any length; d x d numbers must fit a task.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import cut_lineage

SCALE, ORIGIN = 64, 1_000_000
LARGEST = 2.0**60
COMPONENTS = 16
PASSES = 12
ULP = np.finfo(float).eps / 2
# Singular values below this share of the largest are rounding, not variance.
NO_VARIANCE = 1e-10


@dataclass(frozen=True)
class Whitening:
    """``projection`` maps a centred row to its whitened components."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def size(self) -> int:
        return len(self.whole)

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(id, x) of the usable rows of an (id, v) table, v an array of doubles."""
    kind = T.StructType([rows.schema["id"], T.StructField("x", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(batch.column(1).is_valid())
            lists = held.column(1)
            flat = lists.flatten()
            values = np.floor(SCALE * flat.to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            # Nulls are NaN by now, and comparisons with NaN fail.
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < LARGEST))])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1])
            lengths = np.diff(ends)
            x = values[np.repeat(good, lengths)].astype(np.int64) + ORIGIN
            at = np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [held.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(at), pa.array(x))], ["id", "x"])

    return rows.mapInArrow(run, kind)


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def exact_sums(fit: DataFrame, size: int) -> list[int]:
    """Sum of every entry over the (x) rows, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            x = matrix_of(batch.column(0), size)
            if len(x):
                small = float(np.abs(x).max()) * len(x) < 2.0**62
                total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(v) for v in total])], ["i", "total"])

    sums = fit.mapInArrow(run, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in sums.collect()}
    return [found[i] for i in range(size)]


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - whole) - rest / n


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, size: int, rows_of) -> np.ndarray:
    """Sum of b' b over the rows b = ``rows_of(x)``: one matrix per task, added up by matrix row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                b = rows_of(matrix_of(batch.column(0), size))
                total = b.T @ b if total is None else total + b.T @ b
        if total is not None:
            yield _matrix_rows(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = values.values.to_numpy()
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield _matrix_rows(total)

    kind = "i int, g array<double>"
    rows = fit.mapInArrow(run, kind).repartition("i").mapInArrow(add, kind).toArrow()
    order = np.argsort(rows.column("i").to_numpy())
    return np.array(rows.column("g").to_pylist(), float)[order]


def _matrix_rows(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    flat, width = np.concatenate(list(rows.values())), len(next(iter(rows.values())))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["i", "g"])


def triangular_factors(grams, n: int, size: int) -> list[np.ndarray]:
    """Factors of shifted CholeskyQR; ``grams(factors)`` is the Gram matrix of the rows solved by the factors so far."""
    factors: list[np.ndarray] = []
    for turn in range(PASSES):
        g = grams(factors)
        # Symmetric up to rounding by construction; the halves are averaged so that it is exactly.
        g = (g + g.T) / 2
        if turn and np.abs(g @ g - g).max() <= 64 * size * ULP:
            break
        values = np.linalg.eigvalsh(g)
        if values[-1] <= 0:
            return []
        if not turn:
            shift = 11 * (n * size + size * (size + 1)) * ULP * values[-1]
        else:
            shift = 0.0 if values[0] > 1e-8 * values[-1] else 64 * size * ULP * values[-1]
        factors.append(np.linalg.cholesky(g + shift * np.eye(size)).T)
    return factors


def train(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of ``df``, with at most ``components`` components."""
    rows = whole_numbers(df.select(F.lit(0).alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")))
    fit = cut_lineage(rows.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not common:
        none = np.empty(0)
        return Whitening(0, none.astype(np.int64), none.astype(np.int64), np.empty((0, 0)), none, none, None)
    size, n = common[0]["size"], common[0]["n"]
    fit = fit.where(F.size("x") == size)
    sums = exact_sums(fit, size)
    whole, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (int.__floordiv__, int.__mod__))

    def grams(factors: list[np.ndarray]) -> np.ndarray:
        def rows_of(x: np.ndarray) -> np.ndarray:
            a = centred(x, whole, rest, n)
            for r in factors:
                a = solved(a, r)
            return a

        return gram(fit, size, rows_of)

    product = np.eye(size)
    factors = triangular_factors(grams, n, size)
    for r in factors:
        product = r @ product
    _, singular, right = np.linalg.svd(product if factors else np.zeros((size, size)))
    kept = min(components, int((singular > NO_VARIANCE * singular[0]).sum()))
    axes = right[:kept].T
    # One sign for all rows: the largest entry of a component is positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    values = singular**2 / n
    error, projection = None, axes / np.sqrt(values[:kept])
    if kept:
        seen = gram(fit, size, lambda x: centred(x, whole, rest, n) @ projection) / n
        error = float(np.abs(seen - np.eye(kept)).max())
    return Whitening(n, whole, rest, axes, values[:kept], values[:kept] / (values.sum() or 1.0), error)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n x - S)^2 over the entries of every row, exact; None where it is no long."""
    # n x - S = n (x - floor(S / n)) - S mod n
    off = x - model.whole
    if len(x) and (np.abs(off).max() + 1.0) ** 2 * model.n**2 * model.size >= 2.0**62:
        exact = ((off.astype(object) * model.n - model.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]
    return ((off * model.n - model.rest) ** 2).sum(axis=1).tolist()


def whitened(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of every usable row of ``df``; ``whitened`` holds its components in order."""
    rows = whole_numbers(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")))
    kind = T.StructType([
        rows.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    size, kept = model.size, model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(1), size)
            z = centred(x, model.whole, model.rest, model.n) @ model.projection
            ends = np.arange(len(z) + 1, dtype=np.int32) * kept
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(deviations(x, model), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], [f.name for f in kind.fields])

    return rows.where(F.size("x") == size).mapInArrow(run, kind)
