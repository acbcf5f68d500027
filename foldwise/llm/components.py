"""Connected components of an edge table by least labels and pointer jumping; no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges(a, b)``: the smallest id reachable.

    A round takes the least label among neighbours (pre-aggregated before the shuffle) and then the label's own label,
    so chains shrink by halves and stars settle at once. Joins run between written tables, so Spark can split a node
    that has very many edges. Null ends are left out; an empty table gives an empty result.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    both = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        least = both.join(labels.select(F.col("id").alias("b"), "component"), "b") \
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        step = materialize(labels.join(least, "id").select("id", "component", F.least("component", "least").alias("next")))
        up = step.select(F.col("id").alias("next"), F.col("next").alias("top"))
        new = materialize(step.join(up, "next").select("id", F.col("top").alias("new"), "component"))
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("id", F.col("new").alias("component"))
        if not changed:
            return labels
