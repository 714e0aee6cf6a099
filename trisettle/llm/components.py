"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trisettle.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``a long, b long`` to ``node, component``: the smallest node that links reach; nodes without edges are absent.

    Every round each node takes the smallest label of its neighbours and then its label's label, so paths halve;
    each round's labels are written, and rounds end when no label changes. A node with very many edges is an
    aggregate with partial sums and one side of a join that may be split.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("root"))
        new = written(lower.join(jump, F.col("component") == F.col("at"), "left").select("node", F.least("component", "root").alias("component"), "old"), "labels")
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
