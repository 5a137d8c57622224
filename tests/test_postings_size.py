"""The index is written in parts of a bounded size, and postings are found without moving them, whatever the number of pairs."""

from pyspark.sql import functions as F

from labelwright.operators import postings as ps


def corpus(spark, n):
    words = F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id") % 50), F.lit("common"))
    return spark.range(n).select(F.col("id").alias("chunk_id"), F.col("id").alias("insert_ord"), words.alias("text"))


def test_parts_and_pairs(spark, tmp_path, monkeypatch):
    corpus(spark, 800).coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    queries = spark.createDataFrame([(1, "w3 x10"), (2, "common x7 x7"), (3, "absent"), (4, None)], "query_id int, query string")
    monkeypatch.setattr(ps, "WRITE_TASK_BYTES", 100)
    index = ps.write_postings(docs, f"{tmp_path}/index", ["text"], segment=16)
    assert len(index.blocks.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = ps.search_postings(queries, index, 5)
    monkeypatch.setattr(ps, "HELD_PAIRS", 0)
    moved = ps.search_postings(queries, index, 5)
    for a, b in ((sent.top, moved.top), (sent.bounds, moved.bounds)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.query_id for r in sent.top.collect()} == {1, 2}
