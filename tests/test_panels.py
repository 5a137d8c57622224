"""Panels merged per package, in batch and over a stream; pages by the table function."""

import datetime as dt

from pyspark.sql import functions as F

from labelwright.functions.pages import PagesOf, register_pages
from labelwright.operators.corpus import split_pages
from labelwright.queries.streams import delivered
from labelwright.streaming.panels import merged_panels

SCHEMA = "package string, panel long, at timestamp, mrp string, qty string"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


PANELS = [
    ("a", 2, at(5, 3), "20", None), ("a", 1, at(5, 3), "10", "5 g"), ("a", 3, at(5, 1), None, None), ("a", 4, at(6), "30", "6 g"),
    ("b", 5, at(5), None, None), (None, 6, at(5), "9", ""),
]
WANT = {("a", 3, "10", "5 g"), ("a", 1, "30", "6 g"), ("b", 1, None, None), (None, 1, "9", "")}


def rows_of(df):
    return sorted((r.package or "", r.n_panels, r.mrp, r.qty) for r in df.collect())


def test_batch_takes_earliest_values_and_drops_repeats(spark):
    panels = spark.createDataFrame(PANELS * 2, SCHEMA)
    got = merged_panels(panels, "package", "panel", "at", ["mrp", "qty"])
    assert rows_of(got) == sorted((p or "", *rest) for p, *rest in WANT)
    assert merged_panels(panels.limit(0), "package", "panel", "at", ["mrp", "qty"]).count() == 0


def test_stream_equals_batch_whatever_the_order(spark):
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (
        PANELS[3:], PANELS[:4], [("z", 9, at(20), None, None)], [("a", 7, at(5), "1", "1")], [("z", 10, at(28), None, None)])]
    out, late = delivered(spark, frames, lambda p: merged_panels(p, "package", "panel", "at", ["mrp", "qty"]))
    assert late == 1
    # The periods of the two closing rows: one over, one still open.
    assert rows_of(out.where(~F.col("package").eqNullSafe("z"))) == sorted((p or "", *rest) for p, *rest in WANT)


def test_table_function_cuts_pages_like_the_columns(spark):
    mark = "---PAGE_BREAK---"
    texts = [None, "", " \t　", f"a{mark}", f"{mark}{mark} b\x1c ", "x" * 100_000 + mark + " y\x85", "---PAGE_BREAK--"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    register_pages(spark)
    want = sorted(tuple(r) for r in split_pages(docs).select("doc", "page_number", "text").collect())
    got = spark.sql("SELECT d.doc, p.* FROM {docs} AS d, LATERAL pages_of(d.text) AS p", docs=docs).collect()
    assert sorted(map(tuple, got)) == want
    d = docs.alias("d")
    joined = d.lateralJoin(PagesOf(F.col("d.text").outer()).alias("p")).select("d.doc", "p.page_number", "p.text")
    assert sorted(map(tuple, joined.collect())) == want
