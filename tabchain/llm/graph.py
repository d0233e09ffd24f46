"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabchain.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the least node names it.

    Each round gives a node the least label among its own and its neighbours', then
    the label of that label, until nothing changes. Neighbours are combined before
    they are shuffled, and each round is written to the shared folder, so a hub of
    any degree is no list and a lost executor repeats one round at most.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").filter("node <> other").distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels"
    )
    while True:
        heard = (
            both.join(labels.toDF("other", "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("least"))
        jumped = nearer.join(labels.toDF("least", "further"), "least", "left").select(
            "node",
            F.coalesce(F.least("least", "further"), "least").alias("component"),
            (F.coalesce(F.least("least", "further"), F.col("least")) != F.col("component")).alias("changed"),
        )
        written = stored(jumped, "labels")
        labels = written.select("node", "component")
        if written.filter("changed").isEmpty():
            return labels
