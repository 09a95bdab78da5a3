"""Connected components of an undirected graph, by hooking to smaller neighbours and pointer jumping.

Edges with a null end and loops join nothing; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Every round hooks each node that has a smaller neighbour to the smallest one, follows the hooks to their ends by
    doubling, and contracts the graph; of any edge at least one end is hooked, so the rounds are logarithmic in the
    nodes. Each step is written out, so lost executors cost no more than the step.
    """
    live = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    labels = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    first = True
    while not live.isEmpty():
        hooks = materialize(live.groupBy("b").agg(F.min("a").alias("p")).withColumnRenamed("b", "v"), "hooks")
        while True:
            up = hooks.select(F.col("v").alias("u"), F.col("p").alias("q"))
            jumped = materialize(hooks.join(up, hooks["p"] == up["u"], "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        if first:
            nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
            labels = materialize(nodes.join(hooks, F.col("node") == F.col("v"), "left").select("node", F.coalesce("p", "node").alias("component")), "labels")
            first = False
        else:
            labels = materialize(labels.join(hooks, F.col("component") == F.col("v"), "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        ha, hb = hooks.select(F.col("v").alias("va"), F.col("p").alias("pa")), hooks.select(F.col("v").alias("vb"), F.col("p").alias("pb"))
        moved = live.join(ha, live["a"] == F.col("va"), "left").join(hb, live["b"] == F.col("vb"), "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        live = materialize(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
