"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of ``edges(a, b)`` (numbers without order, such as hashes); label is one of its component's nodes.

    In each round every node takes the least of itself and its neighbours, edges are drawn anew between what their
    ends took, and labels follow. A round leaves a fraction of the nodes of any shape. Each is cut off in a written
    table; edges that join a node to itself go.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    first = True
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).toDF("node", "other")
        took = stored(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("took")), name)
        if first:
            labels, first = took.toDF("node", "label"), False
        else:
            labels = stored(labels.join(took.toDF("label", "took"), "label", "left").select("node", F.coalesce("took", "label").alias("label")), name)
        both = edges.join(took.toDF("a", "x"), "a").join(took.toDF("b", "y"), "b").where("x <> y")
        edges = stored(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    return labels
