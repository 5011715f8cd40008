"""Connected components of an edge table, by min-label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, release


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node reachable from each node of `edges` (a, b: long).

    Every round hooks each label to the smallest label next to it and then follows labels of labels, so the number of
    rounds grows with the logarithm of a chain's length. All state stays in tables on the shared folder.
    Repeated edges, loops and an empty table are fine; rows with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        # The label of each node's neighbours; the smallest goes to the node and to the node's own label.
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        told = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        told = materialize(told, f"{name}-told")
        hooks = told.where("least < label").groupBy(F.col("label").alias("root")).agg(F.min("least").alias("hook"))
        hooks = materialize(hooks, f"{name}-hooks")
        if hooks.isEmpty():
            release(told, hooks, both)
            return labels
        hooked = told.join(hooks, told.label == hooks.root, "left").select("node", F.least("least", F.coalesce("hook", "least")).alias("label"))
        hooked = materialize(hooked, f"{name}-hooked")
        up = hooked.select(F.col("node").alias("at"), F.col("label").alias("above"))
        jumped = hooked.join(up, hooked.label == up["at"], "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"))
        new = materialize(jumped, f"{name}-{step}")
        release(labels, told, hooks, hooked)
        labels = new
