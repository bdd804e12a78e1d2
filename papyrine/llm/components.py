"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.workspace import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``links``; root is the smallest node of its component.

    Each round gives a node the smallest label among its neighbours and then the label of
    that label, so long chains shorten by half; a round's labels are written to the shared
    folder. Hubs cost nothing extra: minima are combined before the shuffle.
    """
    one_way = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = written(one_way.union(one_way.select("other", "node")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        known = labels.select(F.col("node").alias("other"), F.col("root").alias("near"))
        nearest = both.join(known, "other").groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(nearest, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = hooked.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "root")
        labels = written(moved.select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("moved")), "labels")
    return labels.select("node", "root")
