"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence.  The program
"cover the length histogram with as few configurations as possible" has one row
per length (at most 2047) whatever the corpus, so it is solved on the driver:
multiplicative weights price the lengths (long and little-covered ones dearer),
a knapsack dynamic program finds the dearest configuration, and so on.  The
fractional solution is rounded down; what is left is filled length by length,
largest first, each time with the largest length that still fits.

Documents never meet: a task numbers its pieces by length, the counts per
(length, task) are summed up, and each piece finds its sequence and offset from
its number alone.

Results: a document is the ids of its text and one end id.  Null and empty texts
are one end id.  Only documents longer than a sequence are cut, the first piece
being the short one.  Repeated rows are packed as often as they occur.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import cut_lineage


CAPACITY = 2048
END_ID = 0
ROUNDS = 300
RATE = 1.0
SHARE = 0.5
# Characters on which both readers of the vocabulary are tested to agree.
PLAIN = re.compile(r"[^\x00-\x7f¡-ɏ‘-‟]")


@lru_cache(maxsize=4)
def byte_bpe(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """ids of a text by the ``tokenizers`` vocabulary file.

    Given the same vocabulary as ranks, plain Latin texts without a special
    token's string go the faster way to the same ids.
    """
    @lru_cache(maxsize=1)
    def tokenizer():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def slow(text: str) -> list[int]:
        return tokenizer().encode(text, add_special_tokens=False).ids

    if not ranks:
        return slow
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(text: str) -> list[int]:
        if "<|" in text or PLAIN.search(text):
            return slow(text)
        return fast.encode_ordinary(text)

    return ids


def pieces(docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], capacity: int) -> DataFrame:
    """Pieces of every document of a (doc, text) table, numbered by length within the task (``task``, ``nth``)."""
    kind = T.StructType([
        T.StructField("doc", docs.schema["doc"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType()),
        T.StructField("task", T.LongType()), T.StructField("nth", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, task, counted = encode(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = np.array((of(text) if text else []) + [END_ID], "<u4")
                cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    nth.append(int(counted[b - a]))
                    counted[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc, [task] * len(row), nth)], [f.name for f in kind.fields])

    return docs.mapInArrow(run, kind)


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """The configuration with the highest total price: an unbounded knapsack by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(lengths, room, side="right")
        if n:
            value = best[room - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], choice[room] = value[k], k
    out, room = Counter(), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            out[int(choice[room])] += 1
            room -= int(lengths[choice[room]])
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> list[tuple[Counter, float]]:
    """Configurations and how often each is used, covering no length more than it occurs."""
    covered, out = np.zeros(len(lengths)), []
    for _ in range(rounds):
        left = np.maximum(counts - covered, 0.0)
        if not (left >= 1).any():
            break
        # A length's share covered so far lowers its price; one fully covered has none.
        prices = lengths / capacity * np.exp(-RATE * covered / counts) * (left >= 1)
        config = dearest(prices, lengths, capacity)
        if not config:
            break
        step = min(left[k] / a for k, a in config.items())
        step = step if step < 2 else step * SHARE
        for k, a in config.items():
            covered[k] += a * step
        out.append((config, step))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[list[int], int]]:
    """Configurations (lengths, longest first) with whole multiplicities that hold every piece exactly once.

    At most one configuration per round and a few per length: the plan's size
    depends on ``capacity`` and ``rounds``, not on the corpus.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    out: list[tuple[list[int], int]] = []

    def use(config: Counter, times: int) -> None:
        if times > 0:
            for k, a in config.items():
                left[k] -= a * times
            out.append((sorted((int(lengths[k]) for k, a in config.items() for _ in range(a)), reverse=True), times))

    for config, times in fractional(lengths, left.astype(float), capacity, rounds):
        use(config, min(int(times), *(int(left[k]) // a for k, a in config.items())))
    while (left > 0).any():
        taken, room = np.zeros_like(left), capacity
        while len(fits := np.flatnonzero((left > taken) & (lengths <= room))):
            k = fits[-1]
            times = min(left[k] - taken[k], room // lengths[k])
            taken[k] += times
            room -= int(times * lengths[k])
        config = Counter({int(k): int(taken[k]) for k in np.flatnonzero(taken)})
        use(config, min(int(left[k]) // a for k, a in config.items()))
    return out


def slots(configs: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first number served, first sequence and offset of each slot."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    served, sequence = Counter(), 0
    for lengths, times in configs:
        offset = 0
        for n in lengths:
            found.setdefault(n, []).append((served[n], sequence, offset))
            served[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in found.items()}


def pack(
    docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc, piece, start, length, crc, sequence, offset); ``encode`` is called once a task and gives the tokenizer."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    cut = cut_lineage(pieces(narrow, encode, capacity))
    counts = cut_lineage(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(histogram, capacity, rounds), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "task"]).select(
        "doc", "piece", "start", "length", "crc", (F.col("base") + F.col("nth")).alias("number"))
    kind = T.StructType([*numbered.schema.fields[:5], T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty_like(number), np.empty_like(number)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for n, rows in zip(values, np.split(order, starts[1:])):
                first, base, place = where[int(n)]
                k = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows], offset[rows] = base[k] + number[rows] - first[k], place[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [f.name for f in kind.fields])

    return numbered.mapInArrow(run, kind)
