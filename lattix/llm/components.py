"""Connected components of links, by label spreading and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, drop_written


def components(links: DataFrame) -> DataFrame:
    """``links``: v, w. Returns v, comp for every linked node: comp is the smallest node it reaches. Rounds grow with the logarithm of a component's width.

    Links of a node to itself, or with a null end, count for nothing; repeated links count once. Without links there are no rows.
    """
    both = links.select("v", "w").where("v <> w")
    both = cut(both.unionByName(both.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "links")
    labels = cut(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("comp").alias("c")), "w").groupBy("v").agg(F.min("c").alias("c"))
        low = labels.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("v").alias("comp"), F.col("comp").alias("c"))
        after = cut(low.join(jump, "comp", "left").select("v", "was", F.least("comp", F.coalesce("c", "comp")).alias("comp")), "labels")
        changed = after.where("was <> comp").limit(1).count()
        drop_written(links.sparkSession, labels)
        labels = after
        if not changed:
            drop_written(links.sparkSession, both)
            return labels.select("v", "comp")
