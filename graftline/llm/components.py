"""Connected components of an edge table, distributed.

Every round takes the smallest label among a node's neighbours and then jumps to the label's own
label, so that a path of n nodes needs about log n rounds.  Labels are staged after every round and the round before's deleted.
A component that holds most nodes is a hot key of the jump's join, on the side of the nodes; adaptive execution splits it (the other side
has one row a label), and where that is off it costs time, not memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.staging import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); root is the smallest node of its component.

    Null ends are ignored; repeated edges and loops have no effect; no edges give no rows.
    """
    whole = edges.filter("a is not null and b is not null and a != b")
    both = stage(whole.select("a", "b").unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    staged = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = stage(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("next"), F.col("root").alias("before")), "hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("next").alias("top"))
        jumped = stage(hooked.join(up, F.col("next") == F.col("up")).select("node", F.least("next", "top").alias("root"), "before"), "labels")
        release(staged, hooked)
        labels, staged = jumped.select("node", "root"), jumped
        if jumped.filter("root != before").isEmpty():
            release(both)
            return labels
