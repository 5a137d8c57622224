"""The written BM25 index against the search without one, block skipping, and statistics that follow the corpus."""

import random

import pytest
from pyspark.sql import functions as F

from labelwright.operators import postings as ps
from labelwright.operators.lexical import bm25_topk, build_index, document_frequencies


def texts(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(words)]
    # Few documents are about a topic; all share the frequent words.
    out = []
    for i in range(n):
        topic = [f"topic{i // 10}"] * rng.choice([0, 0, 1, 6])
        out.append(" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(words)], k=rng.randrange(0, 30)) + topic))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"c{i}", i, t if i % 17 else None, "superseded" if i % 7 == 0 else "current") for i, t in enumerate(texts(1, 400))]
    rows += [("same1", 400, "topic3 t1 t1", "current"), ("same2", 401, "topic3 t1 t1", "current")]
    return spark.createDataFrame(rows, "chunk_id string, insert_ord long, text string, status string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, q) for i, q in enumerate(["topic3 t1 t1", "topic20", "t0 t1 t2 t3", "nothing known", "", None, "topic3 topic4 topic5 t59", "t0 t0 t0"])]
    return spark.createDataFrame(rows, "query_id long, query string")


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.insert_ord, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("segment, status, k", [(8, "current", 5), (8, None, 1), (1000, "current", 50), (3, "current", 500)])
def test_same_as_without_index(corpus, asked, tmp_path, segment, status, k):
    index = ps.write_postings(corpus, str(tmp_path / "p"), ["text"], null_token="", segment=segment)
    found = ps.search_postings(asked, index, k, status=status)
    want = bm25_topk(asked, build_index(corpus, ["text"], null_token=""), k, status=status, hold="corpus")
    assert as_rows(found.top) == as_rows(want) and found.top.count() > 0


def test_blocks_are_skipped(corpus, asked, tmp_path):
    index = ps.write_postings(corpus, str(tmp_path / "p"), ["text"], null_token="", segment=8)
    def blocks(k):
        found = ps.search_postings(asked, index, k).bounds.groupBy("query_id").agg(
            F.sum("n_blocks").alias("all"), F.sum(F.when(F.col("read"), F.col("n_blocks"))).alias("read"))
        return {r.query_id: (r["read"], r["all"]) for r in found.collect()}

    one, three = blocks(1), blocks(3)
    assert all(one[q][0] <= three[q][0] <= three[q][1] == one[q][1] for q in one)
    # A rare word's segments are few; frequent ones beside it need not be read.
    assert three[0][0] < three[0][1] / 2 and one[6][0] < one[6][1] / 2


def test_bounds_hold_for_other_statistics(spark, corpus, asked, tmp_path):
    """Statistics of a grown corpus with a written index of the old documents."""
    index = ps.write_postings(corpus, str(tmp_path / "p"), ["text"], null_token="", segment=8)
    more = spark.createDataFrame([(f"m{i}", 1000 + i, t + " t0" * 40, "none") for i, t in enumerate(texts(2, 300))], corpus.schema)
    grown = ps.merged(index.statistics, ps.difference(came=ps.tokenised(more, ["text"], null_token="")))
    found = ps.search_postings(asked, index, 4, statistics=grown)
    want = bm25_topk(asked, build_index(corpus.union(more), ["text"], null_token=""), 4, hold="corpus")
    assert as_rows(found.top) == as_rows(want)


def weights(statistics):
    table, n, mean = ps.weights_of(statistics)
    return {r.token: round(r.idf, 9) for r in table.collect()}, n, round(mean, 9)


def test_statistics_follow_changes(spark, corpus):
    store = ps.tokenised(corpus, ["text"], null_token="")
    batch = ps.tokenised(spark.createDataFrame(
        [("c3", 3, "brand new words", "current"), ("c5", 5, None, "current"), ("n1", 900, "t1 topic3 fresh", "current")], corpus.schema), ["text"], null_token="")
    after = store.join(batch, "chunk_id", "left_anti").unionByName(batch)
    gone = after.filter("chunk_id IN ('c8', 'n1', 'c300')")
    fresh = document_frequencies(after.join(gone, "chunk_id", "left_anti"))
    kept = ps.merged(document_frequencies(store), ps.replaced(store, batch), ps.difference(left=gone))
    assert weights(kept) == weights(fresh)
    assert {r.token: r.n_docs for r in kept.collect()} == {r.token: r.n_docs for r in fresh.collect()}


def test_written_statistics(corpus, tmp_path):
    index = ps.write_postings(corpus, str(tmp_path / "p"), ["text"], null_token="", segment=16)
    assert weights(index.statistics) == weights(document_frequencies(ps.tokenised(corpus, ["text"], null_token="")))


def test_empty(spark, corpus, asked, tmp_path):
    index = ps.write_postings(corpus.limit(0), str(tmp_path / "p"), ["text"])
    assert ps.search_postings(asked, index, 3).top.count() == 0
    assert ps.weights_of(index.statistics)[1:] == (0, 0.0)
