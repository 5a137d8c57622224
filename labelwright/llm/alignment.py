"""Alignment of two tokenizers over the same bytes.

Both tokenizers read the same bytes of a text.  The cumulative byte ends of either
go into an array from end to index; the offsets that both arrays hold are where both
end a token.  They slice both id lists into groups, and the two tokens that end a
group together are a link.

How often the corpus links a pair of ids is counted over all documents: every task
counts the links of its rows by id pair, and the counts are summed up in a shuffle
by pair.  The counts of all pairs are then sent to the tasks.  Their number does not
grow with the corpus: two tokens that end together start or end inside each other's
bytes, so the bytes of one are a suffix of the other's.  For a token of m bytes there
are at most m suffixes, so all pairs are fewer than the bytes of both vocabularies
together (``pair_bound``; about 520 thousand, 12 MB, for vocabularies of 50 and 32
thousand).

Results: a text that is null, empty, or that one tokenizer does not give back byte by
byte (a normalised character, say) has no tokens: zero counts, empty lists.  Texts of
any length are read whole, one at a time.  Every row is a document of its own, so
repeated rows count their links as often as they occur; ids may be null.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import cut_lineage, small_batches
from labelwright.llm.packing import PLAIN

SPACE_MARK = "▁"
# Links that a task gathers before it counts them.
WAITING_LINKS = 1 << 20


@dataclass(frozen=True)
class Reader:
    """A tokenizer: ids of a text, and the bytes of every id."""

    encode: Callable[[str], list[int]]
    bytes_of: list[bytes]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))


class Aligned(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    # Index of the last token of each group, in either array.
    ends_a: np.ndarray
    ends_b: np.ndarray


NOTHING = Aligned(*[np.empty(0, np.int32)] * 4)


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 as it is, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level_reader(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Reader:
    """Byte-level BPE by a ``tokenizers`` file, fed with a space before the text; special tokens' strings are plain text.

    Given the same vocabulary as ranks, plain Latin texts take the faster reader to
    the same ids, and the file is read once another text comes along.
    """
    @lru_cache(maxsize=1)
    def whole():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def slow(text: str) -> list[int]:
        return whole().encode(" " + text, add_special_tokens=False).ids

    if not ranks:
        alphabet = byte_alphabet()
        names = {i: name for name, i in whole().get_vocab(with_added_tokens=True).items()}
        return Reader(slow, [bytes(alphabet[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)])
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    by_rank = {rank: token for token, rank in table.items()}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return Reader(
        lambda text: slow(text) if PLAIN.search(text) else fast.encode_ordinary(" " + text),
        [by_rank.get(i, b"") for i in range(max(by_rank) + 1)])


@lru_cache(maxsize=2)
def piece_reader(model: str) -> Reader:
    """BPE pieces by a ``sentencepiece`` model, which writes the space before the text itself."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)

    def own_bytes(i: int) -> bytes:
        name = pieces.id_to_piece(i)
        if pieces.is_byte(i):
            return bytes([int(name[3:5], 16)])
        return name.replace(SPACE_MARK, " ").encode()

    return Reader(lambda text: pieces.encode(text, num_threads=1), [own_bytes(i) for i in range(pieces.get_piece_size())])


def token_at(ids: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Index of the last token that ends at each of the byte offsets 0 to ``size``; -1 where none does."""
    at = np.full(size + 1, -1, np.int32)
    at[np.cumsum(lengths[ids])] = np.arange(len(ids), dtype=np.int32)
    return at


def aligned(text: str | None, first: Reader, second: Reader) -> Aligned:
    """Tokens of both readers and their groups; nothing where a reader does not give the text back."""
    if not text:
        return NOTHING
    want = b" " + text.encode()
    a, b = first.encode(text), second.encode(text)
    if b"".join(map(first.bytes_of.__getitem__, a)) != want or b"".join(map(second.bytes_of.__getitem__, b)) != want:
        return NOTHING
    a, b = np.array(a, np.int32), np.array(b, np.int32)
    at_a, at_b = token_at(a, first.lengths, len(want)), token_at(b, second.lengths, len(want))
    common = np.flatnonzero((at_a >= 0) & (at_b >= 0))
    return Aligned(a, b, at_a[common], at_b[common])


def names_of(n: int) -> np.ndarray:
    """The ids below ``n`` as text, followed by ``,``, then all by ``|``, then all by ``;``: one row of bytes each, zeros at its end."""
    width = len(str(n)) + 1
    return np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(n)], f"S{width}").view(np.uint8).reshape(-1, width)


def written(found: Aligned, names: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of both sides, group by group; ``names`` holds the ids as text."""
    if not len(found.ends_a):
        return b""
    n, after_a, after_b = len(names) // 3, found.ends_a + 1, found.ends_b + 1
    # A token's place among both sides' tokens: a group's first side comes after the groups before, its second after that.
    place_a = np.arange(after_a[-1]) + np.repeat(after_b - np.diff(after_b, prepend=0), np.diff(after_a, prepend=0))
    place_b = np.arange(after_b[-1]) + np.repeat(after_a, np.diff(after_b, prepend=0))
    ids = np.empty(len(place_a) + len(place_b), np.int64)
    ids[place_a], ids[place_b] = found.a[: len(place_a)], found.b[: len(place_b)]
    ids[place_a[found.ends_a]] += n
    ids[place_b[found.ends_b]] += 2 * n
    return names[ids].tobytes().translate(None, b"\0")[:-1]


def pair_bound(*readers: Reader) -> int:
    """No corpus has more different linked pairs than this: the bytes of all tokens."""
    return sum(len(token) for reader in readers for token in reader.bytes_of)


Readers = Callable[[], tuple[Reader, Reader]]


def groups(docs: DataFrame, readers: Readers, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc, a, b, ends_a, ends_b) per row of ``docs``: ids of both tokenizers and the last index of every group.

    With ``digest`` the ids are replaced by n_a, n_b, the links (link_a, link_b) and a
    hash of the groups, which is a third of the size.  ``readers`` is called once a task.
    """
    lists = ("a", "b", "ends_a", "ends_b")
    doc = docs.select(F.col(f"`{id_col}`").alias("doc")).schema["doc"]
    ints = T.ArrayType(T.IntegerType())
    kind = T.StructType([doc, *[T.StructField(c, ints) for c in lists]]) if not digest else T.StructType([
        doc, T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("link_a", ints),
        T.StructField("link_b", ints), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = readers()
        names, listed = names_of(max(len(first.bytes_of), len(second.bytes_of))), pa.list_(pa.int32())
        for batch in batches:
            if not digest:
                rows = (aligned(text.as_py(), first, second) for text in batch.column(1))
                columns = [pa.array(x, listed) for x in zip(*rows)] if batch.num_rows else [pa.array([], listed)] * len(lists)
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", *lists])
                continue
            n_a, n_b, link_a, link_b, sha = [], [], [], [], []
            for text in batch.column(1):
                found = aligned(text.as_py(), first, second)
                groups = written(found, names)
                n_a.append(len(found.a)), n_b.append(len(found.b))
                link_a.append(found.a[found.ends_a]), link_b.append(found.b[found.ends_b])
                sha.append(hashlib.sha256(groups).hexdigest() if groups else "")
            at = pa.array(np.cumsum([0, *map(len, link_a)]), pa.int32())
            links = (pa.ListArray.from_arrays(at, pa.array(np.concatenate([*x, NOTHING.a]))) for x in (link_a, link_b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), *links, pa.array(sha, pa.string())],
                [f.name for f in kind.fields])

    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, kind)


def keys_of(link_a: pa.Array, link_b: pa.Array) -> np.ndarray:
    """One 64-bit key per link."""
    return link_a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) << 32 | link_b.flatten().to_numpy(zero_copy_only=False)


def link_counts(links: DataFrame) -> DataFrame:
    """(key, n): how often each id pair is linked in a (link_a, link_b) table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

        def added() -> tuple[np.ndarray, np.ndarray]:
            # The running table holds pairs of ids, whose number is bounded.
            more, n = np.unique(np.concatenate([*waiting, keys[:0]]), return_counts=True)
            waiting.clear()
            both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            waiting.append(keys_of(batch.column(0), batch.column(1)))
            if sum(map(len, waiting)) > WAITING_LINKS:
                keys, counts = added()
        keys, counts = added()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return links.select("link_a", "link_b").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, readers: Readers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    n_best counts the links whose pair is the one most often linked with its second
    id, ties included; count_sum adds up the corpus-wide counts of a row's links.
    """
    spark = docs.sparkSession
    found = cut_lineage(groups(docs, readers, id_col, text_col, digest=True))
    with small_batches(spark):
        table = link_counts(found).toArrow()
    order = np.argsort(table.column("key").to_numpy())
    keys, counts = (table.column(c).to_numpy()[order] for c in ("key", "n"))
    second = keys & 0xFFFFFFFF
    highest = np.zeros(int(second.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, second, counts)
    held = spark.sparkContext.broadcast((keys, counts, counts == highest[second]))
    kind = T.StructType([*found.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in (
        "n_groups", "n_links", "n_best", "count_sum")], found.schema["groups_sha256"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = held.value
        for batch in batches:
            link_a, link_b = batch.column(3), batch.column(4)
            sizes = link_a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, keys_of(link_a, link_b))
            stops = np.cumsum(sizes)
            best_sum, count_sum = (
                np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, counts))
            n = pa.array(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], n, n, *(pa.array(x[stops] - x[stops - sizes]) for x in (best_sum, count_sum)), batch.column(5)],
                [f.name for f in kind.fields])

    # Written here, where batches are small: rows of links are as long as the texts.
    return cut_lineage(found.mapInArrow(run, kind))
