"""URL filter: rules first, then a tree of path templates per host.

URLs that a rule fits carry its verdict as their label.  For all others a tree
decides.  Numbers and identifiers in path segments become wildcards, equal
shapes of a host are counted together (so a host with a third of all rows is a
few counted shapes), and the tree is built level by level until no node holds
two shapes.  Children of a node are compared by what follows them: those with
the same commonest next segment are a group, and a child is merged with its
group unless its next segments, or its labels, differ from those of the others
beyond chance.  So names that vary freely become one wildcard, and a branch
without labels shares the template of a labelled one that looks like it.  A
template is rejected when the smoothed share of blocked URLs among its labelled
ones reaches ``PURITY``.

Beyond chance: two samples of sizes m and n from one distribution have
frequencies whose Euclidean distance stays, except with probability ``CHANCE``
each, below ``(1 + sqrt(2 ln(1 / CHANCE))) (1 / sqrt(m) + 1 / sqrt(n))``, however
many outcomes there are (McDiarmid).  For labels, a share, Hoeffding's bound is
taken.  Both need only sums over the next segments, never pairs of children.

Results: a null URL or one without ``://`` has an empty host and path and no
rule; a template without labelled URLs is allowed.  Paths count whole, however
deep; a run of equal segments (``a/a/a``) is one.  Ties for the commonest next
segment go to the smallest.  Repeated rows each count and each get a verdict.
An empty table gives an empty one.  Extra columns are passed on, whatever their
names.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import ascii_lower, cut_lineage, packed

CHANCE = 0.05
PURITY = 0.8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def first_rule(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule (verdict, host, path) that fits; null where none does."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        _, at, prefix = rule
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, value(rule)).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Path segments with identifiers and numbers as wildcards; equal neighbours are one segment marked ``+``."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    typed = F.transform(parts, lambda s: F.regexp_replace(
        F.regexp_replace(s, r"(?i)\b(?=[0-9a-f-]*\d)[0-9a-f]{8,}(-[0-9a-f]{4,})*\b", "{id}"), r"\d+", "{n}"))
    starts = F.transform(typed, lambda s, i: F.when(
        (i == 0) | (s != F.get(typed, i - 1)), F.when(s == F.get(typed, i + 1), F.concat(s, F.lit("+"))).otherwise(s)))
    ending = F.when(F.endswith(path, F.lit("/")), F.array(F.lit("/"))).otherwise(F.expr("cast(array() AS array<string>)"))
    return F.concat(F.array_compact(starts), ending)


def merged_children(rows: DataFrame, level: int) -> DataFrame:
    """(host, template, child, name): what each segment at ``level`` is called below its node.

    Merged children are called ``*?`` and their commonest next segment; no segment of a path holds ``?``.
    """
    node, sums = ["host", "template"], [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    pairs = cut_lineage(rows.groupBy(
        *node, F.get("shape", F.lit(level)).alias("child"), F.coalesce(F.get("shape", F.lit(level + 1)), F.lit("")).alias("next"),
    ).agg(*sums))
    children = cut_lineage(pairs.groupBy(*node, "child").agg(
        *sums, F.min_by("next", F.struct(-F.col("n"), "next")).alias("usual"), F.sum(F.pow("n", F.lit(2))).alias("squares")))
    group = [*node, "usual"]
    sides = pairs.select(*node, "child", "next", "n").join(children.select(*group, "child"), [*node, "child"])
    totals = cut_lineage(sides.groupBy(*group, "next").agg(F.sum("n").cast("double").alias("all_next")))
    groups = children.groupBy(*group).agg(
        F.count(F.lit(1)).alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
    groups = groups.join(totals.groupBy(*group).agg(F.sum(F.pow("all_next", F.lit(2))).alias("all_squares")), group)
    common = sides.join(totals, [*group, "next"]).groupBy(*node, "child").agg(F.sum(F.col("n") * F.col("all_next")).alias("common"))

    def over(a, b):
        """Quotient of two sums; null where there is nothing to divide by."""
        return F.try_divide(a.cast("double"), b.cast("double"))

    def slack(a, b):
        return 1 / F.sqrt(a) + 1 / F.sqrt(b)

    c = F.col
    rest, rest_labelled = c("all_n") - c("n"), c("all_labelled") - c("labelled")
    distance = F.sqrt(F.greatest(F.lit(0.0), (
        over(c("squares"), c("n") * c("n")) - 2 * over(c("common") - c("squares"), c("n") * rest)
        + over(c("all_squares") - 2 * c("common") + c("squares"), rest * rest))))
    gap = F.abs(over(c("blocked"), c("labelled")) - over(c("all_blocked") - c("blocked"), rest_labelled))
    alike = distance <= (1 + math.sqrt(2 * math.log(1 / CHANCE))) * slack(c("n"), rest)
    agree = (c("labelled") == 0) | (rest_labelled == 0) | (
        gap <= math.sqrt(math.log(2 / CHANCE) / 2) * slack(c("labelled"), rest_labelled))
    name = F.when((c("kinds") > 1) & alike & agree, F.concat(F.lit("*?"), c("usual"))).otherwise(c("child"))
    return children.join(groups, group).join(common, [*node, "child"]).select(*node, "child", name.alias("name"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, blocked, template) of a table without the last."""
    node, done = ["host", "template"], []
    rows = shapes.withColumn("template", F.lit(""))
    for level in itertools.count():
        kinds = rows.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"))
        placed = cut_lineage(rows.join(kinds, node))
        # A path that is over, or the only shape of its node, is its own template from here on.
        over = (F.col("kinds") == 1) | (F.size("shape") <= level)
        tail = F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(0)))
        done.append(placed.where(over).withColumn("template", F.concat_ws("/", "template", tail)).drop("kinds"))
        going = placed.where(~over).drop("kinds")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = F.get("shape", F.lit(level))
        named = merged_children(going, level).withColumnRenamed("child", "_child")
        rows = cut_lineage(going.withColumn("_child", at).join(named, [*node, "_child"]).withColumn(
            "template", F.concat_ws("/", "template", "name")).drop("_child", "name"))


def rejected_shapes(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity) that the labelled URLs reject; ``pages``: host, path, blocked (null: no label)."""
    shapes = cut_lineage(pages.groupBy("host", shape(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"),
        F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("blocked")))
    rows = templates(shapes)
    pure = rows.groupBy("host", "template").agg(F.sum("labelled").alias("k"), F.sum("blocked").alias("b"))
    pure = pure.select("host", "template", ((F.col("b") + 1) / (F.col("k") + 2)).alias("purity")).where(F.col("purity") >= PURITY)
    return cut_lineage(rows.join(cut_lineage(pure), ["host", "template"]).select("host", "shape", "template", "purity"))


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """(row, host, path, rule, template, verdict); template is set where one rejects."""
    url = F.col(f"`{url_col}`")
    df = packed(pages, url=url).select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    df = df.select(
        "row", "host", "path", first_rule(rules, host, path, lambda r: F.lit(r[1] + r[2])).cast("string").alias("rule"),
        first_rule(rules, host, path, lambda r: F.lit(r[0])).cast("string").alias("ruled"))
    bad = rejected_shapes(df.select("host", "path", (F.col("ruled") == "block").alias("blocked")))
    both = df.withColumn("shape", shape(path)).join(bad.drop("purity"), ["host", "shape"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return both.select("row", "host", "path", "rule", "template", verdict.alias("verdict"))
