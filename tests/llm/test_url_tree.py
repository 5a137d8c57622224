"""The URL tree against a plain version that compares children one by one, and its reach beyond the rules."""

import random

import brute
from labelwright.llm import queries, url_templates

SCHEMA = "host string, path string, blocked boolean"


def rejected(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {(r.host, tuple(r["shape"])) for r in url_templates.rejected_shapes(pages).collect()}


def test_whole_table_equals_plain_version(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have too few labelled URLs a host
    got = queries.op6_url_templates(spark, folder).collect()
    bad = brute.url_rejected([(r.host, r.path, r.verdict == "block" if r.rule else None) for r in got])
    unruled = [r for r in got if r.rule is None]
    for r in unruled:
        assert r.verdict == ("block" if (r.host, brute.url_shape(r.path)) in bad else "allow")
    assert {r.verdict for r in unruled} == {"allow", "block"}


def test_odd_paths_equal_plain_version(spark):
    pick = random.Random(3)
    words = ["a", "b", "de", "en", "x1", "y.html", "{n}", "*", "*?", "0123456789abcdef", "é"]
    rows = []
    for _ in range(1500):
        path = "".join("/" + pick.choice(words[: 3 + i * 2]) for i in range(pick.randint(0, 6))) + pick.choice(["", "/"])
        rows.append((pick.choice("ghh"), path, pick.choice([True, True, False, None]) if path < "/c" else pick.choice([None, True])))
    rows += [("deep", "/a" * 3000 + f"/b/{i}", True) for i in range(9)] + [("", "", None)]
    bad = rejected(spark, rows)
    assert bad == brute.url_rejected(rows) and bad


def test_unlabelled_branch_follows_the_labelled_one_it_resembles(spark):
    rows = [("h", f"/de/{i}.html", True) for i in range(20)] + [("h", f"/en/{i}.html", None) for i in range(20)]
    rows += [("h", f"/about/team/{i}", None) for i in range(20)]
    # Branches that look alike but whose labels differ stay apart.
    rows += [("k", f"/de/{i}.html", True) for i in range(20)] + [("k", f"/fr/{i}.html", False) for i in range(20)]
    # What differs in the fifth segment and beyond is told apart.
    rows += [("m", f"/1/2/3/x/good/{i}", False) for i in range(20)] + [("m", f"/1/2/3/x/bad/{i}", True) for i in range(20)]
    bad = rejected(spark, rows)
    assert bad == {("h", ("de", "{n}.html")), ("h", ("en", "{n}.html")), ("k", ("de", "{n}.html")), ("m", ("{n}+", "x", "bad", "{n}"))}
