"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioscope.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``links`` (a, b).

    Every round a node takes the smallest label among its neighbours and then the
    label of its label, so a chain shortens by doubling.  Labels are written each
    round; a hub is met by a map-side minimum, never gathered.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp"))
    labels = written(labels, "labels")
    while True:
        heard = (edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node"))
                 .agg(F.min("comp").alias("heard")))
        lower = labels.join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("next"))
        own = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        step = written(lower.join(own, "next").select("node", F.col("comp").alias("was"), F.least("next", "jump").alias("comp")),
                       "labels")
        labels = step.select("node", "comp")
        if step.where("was <> comp").isEmpty():
            return labels
