"""Top-k scoring of one large side against one held side, inside Arrow batches.

The held side is collected only after its size is proven, and only in blocks of
a bounded size; the large side streams past it once per block and never
shuffles.  Each task keeps k rows per held item, so what is shuffled for the
final ranking is k rows per task and item, not the scored pairs.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores are compared at this precision, so that equal rows tie wherever they are computed.
SCORE_DIGITS = 9

# scorer(batch) -> scores[rows of the batch, held items]; NaN marks a pair that is no candidate.
Scorer = Callable[[pa.RecordBatch], np.ndarray]
_CELLS = 4_000_000
# A held block has at most about this many items, since each task keeps k rows per item.
HELD_ITEMS = 2_000


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a score table stays within a fixed number of cells."""
    rows = max(1, _CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score down, order up); ties at the cut are settled by order."""
    live = np.flatnonzero(~np.isnan(scores))
    if live.size > k:
        cut = np.partition(scores[live], live.size - k)[live.size - k]
        live = live[scores[live] >= cut]
    return live[np.lexsort((order[live], -scores[live]))][:k]


def best_rows_per_item(
    rows: DataFrame, make_scorer: Callable[[], Scorer], n_items: int, k: int, id_col: str, order_col: str
) -> DataFrame:
    """The k best rows for each held item: (item_no, id, order, score, rank)."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        kept: list[tuple[np.ndarray, np.ndarray, list]] = [
            (np.empty(0), np.empty(0, np.int64), []) for _ in range(n_items)
        ]
        kind = None
        for batch in _slices(batches, n_items):
            kind = batch.schema.field(id_col).type
            table = np.round(score(batch), SCORE_DIGITS)
            order = batch.column(order_col).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(id_col)
            for item in range(n_items):
                pick = _best(table[:, item], order, k)
                if pick.size == 0:
                    continue
                s0, o0, i0 = kept[item]
                s = np.concatenate([s0, table[pick, item]])
                o = np.concatenate([o0, order[pick]])
                i = i0 + ids.take(pa.array(pick)).to_pylist()
                again = _best(s, o, k)
                kept[item] = (s[again], o[again], [i[j] for j in again])
        out = [(item, i, int(o), float(s)) for item, (ss, oo, ii) in enumerate(kept) for s, o, i in zip(ss, oo, ii)]
        if out:
            item, ids, order, scores = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, kind), pa.array(order, pa.int64()), pa.array(scores)],
                names=["item_no", id_col, order_col, "score"],
            )

    found = rows.mapInArrow(task, f"item_no int, {id_col} {id_type}, {order_col} bigint, score double")
    best = W.partitionBy("item_no").orderBy(F.desc("score"), F.col(order_col))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_items_per_row(
    rows: DataFrame, make_scorer: Callable[[], Scorer], n_items: int, k: int, id_col: str
) -> DataFrame:
    """The k best held items for each row, ranked inside the row's batch: (id, item_no, score, rank)."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        for batch in _slices(batches, n_items):
            table = np.round(score(batch), SCORE_DIGITS)
            blank = np.isnan(table)
            # A stable sort leaves equal scores in item order.
            order = np.argsort(np.where(blank, np.inf, -table), axis=1, kind="stable")[:, :k]
            picked = np.take_along_axis(table, order, axis=1)
            keep = ~np.isnan(picked)
            row, place = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(row)),
                    pa.array(order[row, place].astype(np.int32)),
                    pa.array(picked[row, place]),
                    pa.array((place + 1).astype(np.int32)),
                ],
                names=[id_col, "item_no", "score", "rank"],
            )

    return rows.mapInArrow(task, f"{id_col} {id_type}, item_no int, score double, rank int")


def in_blocks(held: DataFrame, item: str, weight: str, max_weight: int) -> list[DataFrame]:
    """Cut the held side into blocks of bounded weight and item count; a hash of the item decides."""
    total, items = held.agg(F.coalesce(F.sum(weight), F.lit(0)), F.countDistinct(item)).first()
    n = max(1, -(-int(total) // max_weight), -(-int(items) // HELD_ITEMS))
    if n == 1:
        return [held]
    key = F.pmod(F.xxhash64(F.col(item)), F.lit(n))
    return [held.filter(key == b) for b in range(n)]
