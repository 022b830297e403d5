"""Connected components of a links table, without leaving the cluster.

Labels start as the least neighbour and shrink by two joins a round: each node
takes the least label among its neighbours, then the label of its label.  A
component of diameter d needs about log2(d) rounds.  Each round is written to
the shared folder, which cuts the lineage.  Minimums are pre-aggregated before
each shuffle; joins have one row a node on one side, so a hub is split by the
skew join rule of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import discard, table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the least node that can be reached."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = table(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = table(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        taken = labels.select("node", "label").join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        taken = table(taken, "taken")
        up = taken.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = taken.join(up, "label", "left").select("node", "before", F.least("label", F.coalesce("higher", "label")).alias("label"))
        before, labels = labels, table(jumped, "labels")
        discard(before, taken)
        if not labels.where("label <> before").head(1):
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
