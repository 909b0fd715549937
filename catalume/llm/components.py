"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import durable


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, component)``, the smallest node that each node reaches.

    Each round hooks every label under the smallest label beside it and then follows that
    label's own label, so chains shrink geometrically. Labels and edges live in the shared
    folder; the driver sees a count of changes only. Null ends are ignored; no edges give
    an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        root = hooked.groupBy(F.col("was").alias("root")).agg(F.min("to").alias("root_to"))
        step = hooked.join(root, hooked["to"] == root["root"], "left").select("node", F.coalesce(F.least("to", "root_to"), "to").alias("component"), "was")
        step = durable(step)
        if step.where("component <> was").isEmpty():
            return labels
        labels = step.select("node", "component")
