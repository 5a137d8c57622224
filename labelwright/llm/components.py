"""Connected components by contraction, all in tables.

Each round every node takes its least neighbour as parent, parents are followed
to their end, and the edges are rewritten between the ends; edges inside one
component vanish.  Rounds needed grow with the logarithm of the component size.
Each table is written to the checkpoint folder, so joins meet plain shuffles
that the optimiser can split when one component holds most nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import cut_lineage


def _followed(parents: DataFrame) -> DataFrame:
    """Parents replaced by the end of their chain."""
    while True:
        nxt = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = cut_lineage(parents.join(nxt, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        parents = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the least node reachable."""
    def ordered(df: DataFrame) -> DataFrame:
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return df.where(F.col("a") != F.col("b")).select(low, high).distinct()

    rest = cut_lineage(ordered(edges))
    labels = None
    while not rest.isEmpty():
        parents = _followed(cut_lineage(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))))
        if labels is None:
            roots = rest.select(F.col("a").alias("node")).distinct().join(parents, "node", "left_anti")
            labels = cut_lineage(parents.union(roots.select("node", F.col("node").alias("parent"))))
        else:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            labels = cut_lineage(labels.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")))
        ends = parents.select(F.col("node"), F.col("parent").alias("end"))
        for side in ("a", "b"):
            to = ends.select(F.col("node").alias(side), "end")
            rest = rest.join(to, side, "left").withColumn(side, F.coalesce("end", side)).drop("end")
        rest = cut_lineage(ordered(rest))
    if labels is None:
        node = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], "node long, component long").select(
            F.col("node").cast(node).alias("node"), F.col("component").cast(node).alias("component"))
    return labels.select("node", F.col("parent").alias("component"))
