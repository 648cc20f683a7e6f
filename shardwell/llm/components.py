"""Connected components of an edge table, in rounds of hooking and pointer jumping. Nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). v, label for each node that has an edge; label is the component's smallest node.

    Each round every node looks at its neighbours' labels; a label with a smaller one beside it hooks
    onto that, and chains of hooks are shortened. Rounds grow with the logarithm of a component's width.
    Aggregations combine before they shuffle, so a node with very many edges is no single task's work.
    """
    e = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges", narrow=True)
    labels = written(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels", narrow=True)
    for _ in range(MOST_ROUNDS):
        near = e.join(labels, e["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        hooks = written(labels.join(near, "v").filter("m < label").groupBy("label").agg(F.min("m").alias("to")), "hooks", narrow=True)
        if hooks.isEmpty():
            return labels
        short = hooks
        for _ in range(2):
            ahead = short.select(F.col("label").alias("to"), F.col("to").alias("next"))
            short = short.join(ahead, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        labels = written(labels.join(short, "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels", narrow=True)
    raise RuntimeError("components did not settle")
