"""Connected components of an edge table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so labels travel twice
    as far every round. Labels are written to the shared folder after each round, which cuts the lineage; only the number
    of changed labels reaches the driver. Loops and repeated edges do no harm; edges with a null end are left out.
    """
    known = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = durable(known.union(known.select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = durable(both.groupBy("node").agg(F.min("other").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other")
                .groupBy("node").agg(F.min("c").alias("c")))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = durable(hooked.join(jump, "c").select(
            "node", F.least("c", "far").alias("component"), (F.least("c", "far") != F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if not new.filter("moved").limit(1).count():
            return labels
