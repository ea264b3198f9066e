"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of every id in edges (a, b); component is the smallest id that can be reached.

    Each round takes the least label among an id's neighbours and then the label of that label, so paths shrink by
    halves and rounds grow with the logarithm of the longest one. Every round is one written table; nothing but a changed-rows
    count reaches the driver. Sums are partial, so a hub with very many neighbours is no hot key.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        jumped = labels.alias("l").join(labels.select(F.col("id").alias("via"), F.col("component").alias("further")), F.col("component") == F.col("via"), "left")
        jumped = written(jumped.select("id", F.coalesce("further", "component").alias("component")), "jumped")
        near = both.join(jumped.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = jumped.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("changed"))
        step = written(step, "labels")
        if not step.where("changed").limit(1).count():
            return step.select("id", "component")
        labels = step.select("id", "component")
