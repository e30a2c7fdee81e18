"""Connected components by least-label propagation with pointer jumping, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import common


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b: long): label is the least node of the component.

    Each round takes the least label among a node and its neighbours, then that label's own label, so paths shorten by more
    than half. Labels are joined to edges on written tables, where adaptive execution may split a hub's rows.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.written(both, "cc-edges")
    labels = common.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "cc-labels")
    old: list[str] = []
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        less = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        less = common.written(less, "cc-less", drop=old)
        own = less.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        nxt = less.join(own, F.col("to") == F.col("_n"), "left").select("node", F.least("to", F.coalesce("_t", "to")).alias("label"), "was")
        nxt = common.written(nxt, "cc-labels", drop=old)
        changed = nxt.where("label <> was").limit(1).count()
        labels = nxt.select("node", "label")
        if len(old) > 4:
            gone, old = old[:-2], old[-2:]
            common.remove(spark, gone)
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
