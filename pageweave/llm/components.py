"""Connected components of a table of links, by smallest label with pointer jumping.

Every round takes the smallest label among a node's neighbours, then the label of that label; rounds are written to the shared
folder. Grouping is partial, so a node with very many links costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node it is connected with) of the nodes in links (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        beside = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("m"))
        least = now.join(beside, now["node"] == beside["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = now.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = written(least.join(jump, least["label"] == jump["at"]).select("node", "old", F.least("label", "far").alias("label")), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        now = new.select("node", "label")
