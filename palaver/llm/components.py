"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import join_hot, materialise, release


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links (u, v): label is the component's least node.

    Each round takes the least label next door, then the label's own label
    (pointer jumping), and hands what it found to the node of the old label too
    (hooking), so that all of a cluster follows when one end of it meets a smaller
    label.  Rounds are written to the shared folder and go on until no label
    falls; each lowers one at least, so they end.  A round's table is deleted when
    the next is written.  The label of a node that most links lead to is broadcast
    to them (``join_hot``), so a star's links stay where they are.  An empty table
    of links gives an empty table.
    """
    both = materialise(
        links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).where("u is not null and v is not null").distinct()
    )
    total = both.count()
    ends = both.withColumnRenamed("v", "node")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label"), F.count("*").alias("degree")))
    while True:
        near = (
            join_hot(ends, labels.select("node", "label", "degree"), "node", F.col("degree"), total)
            .select(F.col("u").alias("node"), "label")
            .union(labels.select("node", "label"))
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        old = labels.select("node", F.col("label").alias("old"), "degree")
        low = near.join(up, "label", "left").join(old, "node").select("node", F.least("label", F.coalesce("higher", "label")).alias("label"), "old", "degree")
        none = F.lit(None).cast("long")
        both_ends = F.array(F.struct("node", "label", "old", "degree"), F.struct(F.col("old").alias("node"), "label", none.alias("old"), none.alias("degree")))
        step = materialise(low.select(F.inline(both_ends)).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"), F.max("degree").alias("degree")))
        release(labels)
        labels = step
        if step.where("label <> old").isEmpty():
            release(both)
            return step.select("node", "label")
