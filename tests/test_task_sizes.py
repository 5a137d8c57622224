"""Tasks of a scan stay bounded as tables grow, labels are read once, and no label moves to its evidence."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from labelwright.operators.checks import rule_catalogue
from labelwright.operators.corpus import provisions
from labelwright.operators.extract import DECLARED, extract_fields
from labelwright.plans.compliance import dispatch, food_corpus
from labelwright.plans.evidence_scan import scan_with_evidence
from labelwright.queries.labels import label_scan_verdicts, merge_panels
from labelwright.queries.streams import streaming_scan
from labelwright.session import dealt

LABEL = "image_id string, blocks array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(200_000).select("id", F.rand(1).alias("x")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = dealt(df, size // 40)
    assert 40 <= tasks.rdd.getNumPartitions() <= 42
    assert sorted(r.id for r in tasks.select("id").collect()) == list(range(200_000))
    cores = spark.sparkContext.defaultParallelism
    assert dealt(df).rdd.getNumPartitions() == cores
    # Sources of unknown size, and joins, whose size is guessed as a product.
    assert dealt(spark.createDataFrame(df.limit(3).rdd, df.schema)).rdd.getNumPartitions() == cores
    assert dealt(df.join(df.select("id"), "id")).rdd.getNumPartitions() == cores


def test_large_scans_are_dealt_out(spark, tmp_path, monkeypatch):
    # A table of plenty of bytes per core: its splits hold whole row groups.
    monkeypatch.setattr("pyspark.core.context.SparkContext.defaultParallelism", property(lambda self: 1))
    lines = spark.range(1_000_000).select(
        F.xxhash64("id").alias("l_orderkey"), F.xxhash64("id", F.lit(1)).alias("l_partkey"), F.xxhash64("id", F.lit(2)).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.rand(3).alias("l_extendedprice"),
        F.lit(0.01).alias("l_discount"), F.lit("N").alias("l_returnflag"), F.lit("2024-01-01").cast("timestamp").alias("l_shipdate"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (label_scan_verdicts, merge_panels):
        assert "RoundRobinPartitioning" in plan_of(query(spark, str(tmp_path)))


def test_a_stream_is_dealt_out(spark, tmp_path):
    table = {"p_partkey": range(100), "p_size": [i % 50 + 1 for i in range(100)], "p_retailprice": [900.0 + i for i in range(100)],
             "p_name": ["red green blue"] * 100, "p_brand": ["Brand#1"] * 100}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), f"{tmp_path}/part.parquet")
    stream = spark.readStream.schema("id long").parquet(str(tmp_path))
    assert "Repartition" in dealt(stream)._jdf.queryExecution().analyzed().toString()
    read = streaming_scan(spark, str(tmp_path))
    assert sum(r.n_labels for r in read.collect()) == 100
    # The scan of one small file was written by several tasks.
    assert len(read.inputFiles()) > 1


def test_labels_do_not_move_to_their_evidence(spark):
    rows = [("a", [(None, "MRP Rs. 20.00", 0.9, [0.0, 0.0, 300.0, 20.0])]), ("b", [])]
    found = scan_with_evidence(spark.createDataFrame(rows, LABEL), provisions(spark), food_corpus(rule_catalogue(spark, "fssai")), "2024-01-01")
    assert "Exchange hashpartitioning" not in plan_of(found)
    assert {r.image_id: len(r.field_evidences) for r in found.collect()} == {"a": 1, "b": 0}


def test_every_declaration_is_known(spark):
    texts = ["Ingredients: Wheat Flour, Milk (INS 322)", "MRP Rs. 20.00", "Net Wt 5 g", "FSSAI Lic No. 10012345678901", "Batch No. A1",
             "PKD 01/05/2026", "Use by 01/06/2026"]
    label = [("a", [(None, t, 0.9, [0.0, 50.0 * i, 300.0, 20.0]) for i, t in enumerate(texts)])]
    fields = extract_fields(spark.createDataFrame(label, LABEL)).first().extracted_fields
    assert sorted(f.field_name for f in fields) == sorted(DECLARED)


def test_dispatch_tells_checks_apart_by_their_columns(spark):
    checks = spark.createDataFrame(
        [("q1", "c1", "mrp", "food", None), ("q2", "c1", "mrp", "food", []), ("q3", None, "mrp", "food", ["price"]),
         ("q3", None, "mrp", "food", ["price"])],
        "query_id string, check_id string, field string, commodity_type string, query_terms array<string>")
    found = dispatch(checks, provisions(spark), food_corpus(rule_catalogue(spark, "fssai")), "2024-01-01")
    assert "sha2(" not in plan_of(found)
    rows = found.collect()
    assert sorted((r.query_id, r.routed_domain) for r in rows) == sorted(
        (q, d) for q in ("q1", "q2", "q3", "q3") for d in ("legal_metrology", "fssai"))
    by = {(r.query_id, r.routed_domain): r.chunk_id for r in rows}
    assert by["q1", "legal_metrology"] == by["q2", "legal_metrology"]
