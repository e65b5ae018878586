"""Connected components of an edge table by contraction; no node's edges ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settled


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is one of its nodes.

    Each round sends every node to its smallest neighbour (or itself) and relabels the edges; loops and
    repeated edges go.  Nodes that remain are the smallest of their surroundings, so the graph shrinks
    at least by half a round.
    """
    edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "step")
        steps.append(step)
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
    return settled(found, "components")
