"""Connected components of a distributed graph by contraction: no part of it reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, stored


def _flatten(parents: DataFrame) -> DataFrame:
    """parents (node, parent), parent <= node, with every chain shortened to its root by pointer jumping."""
    held = parents
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stored(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("next"), "parent"), "jump")
        discard(held)
        held, settled = jumped, jumped.filter(F.col("next") != F.col("parent")).isEmpty()
        parents = jumped.select("node", F.col("next").alias("parent"))
        if settled:
            parents.stored_path = jumped.stored_path
            return parents


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id, comp for all nodes (set_id): comp is the least node of its component. edges: a, b.

    Each round hangs every node on its least neighbour, shortens the chains and contracts; a component's nodes at least
    halve, so the rounds are logarithmic in its size.
    """
    labels = nodes.select("set_id", F.col("set_id").alias("comp"))
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct()
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).withColumn("parent", F.least("node", "parent"))
        parents = _flatten(stored(parents, "parents"))
        root = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        held = labels, edges, parents
        labels = stored(labels.join(root("comp"), "comp", "left").select("set_id", F.coalesce("comp_root", "comp").alias("comp")), "labels")
        edges = edges.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = stored(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
        discard(*held)
    return labels
