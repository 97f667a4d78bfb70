"""Connected components of a table of links, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossblock.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (a, b); the root is a node of the component.

    In every round each node steps to its smallest neighbour and links are redrawn between
    the nodes reached. Nodes should be hashes: with names in random order a round removes
    about half of the nodes that are not done. Every round is a written table.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to")).select("at", F.least("at", "to").alias("to")))
        labels = cut(
            labels.join(step.withColumnRenamed("at", "root"), "root", "left")
            .select("node", F.coalesce("to", "root").alias("root"))
        )
        first, second = step.select(F.col("at").alias("a"), F.col("to").alias("x")), step.select(F.col("at").alias("b"), F.col("to").alias("y"))
        moved = edges.join(first, "a").join(second, "b").where("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
