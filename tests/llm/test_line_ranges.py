"""Line dedup: the plan keeps its order, and empty tables stay empty."""

import brute
from labelwright.llm import line_dedup

LINE = "a line that many documents share"


def test_ranges_are_sorted_and_streamed_once(spark, capsys):
    lines = spark.createDataFrame([(1, 1, 0, 5, 5)], "doc long, text_id long, pos int, h1 long, h2 long")
    line_dedup.first_occurrences(lines).explain()
    plan = capsys.readouterr().out
    assert "Sort [h1" in plan and "rangepartitioning(h1" in plan and plan.count("Exchange") == 1


def test_first_occurrence_of_each_document(spark):
    rows = [(d, 0, p, h, h) for d in (None, 1, 2) for h in (7, 8) for p in (4, 9, 2)]
    lines = spark.createDataFrame(rows, "doc long, text_id long, pos int, h1 long, h2 long").repartition(4)
    got = sorted((r.h1, r.doc or 0, r.pos) for r in line_dedup.first_occurrences(lines).collect())
    assert got == [(h, d, 2) for h in (7, 8) for d in (0, 1, 2)]


def test_empty_table_and_a_hot_line(spark):
    docs = [(i, "\n".join([LINE] * (i % 4 + 1) + [f"{i}"])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(df.limit(0), counts=True).count() == 0
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(df, counts=True).collect())
    assert got == brute.line_dedup(docs)
