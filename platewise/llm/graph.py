"""Connected components of an edge table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (x, y); the label is the component's smallest id.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so long chains shrink by half at least. A node with most of all edges is one row
    per task in the aggregate and a split partition in the joins.
    """
    both = stored(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("y")).select("id", F.least("id", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        near = near.join(labels, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        jumped = near.join(far, "label").select("id", F.least("label", "far").alias("label"), "before")
        after = stored(jumped, "labels")
        done = after.filter("label <> before").isEmpty()
        labels = after.select("id", "label")
        if done:
            return labels
