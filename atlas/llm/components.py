"""Connected components of links between long ids, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``links`` (columns a, b).

    Labels pass to neighbours and then along labels, so paths shorten by more than half a round.
    Each round is written to the shared folder; only a count reaches the driver.
    """
    edges = stage(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = stage(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        seen = (edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node")
                .agg(F.min("component").alias("near")))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("end"))
        new = stage(lower.join(jump, "via", "left").select(
            "node", "was", F.least("via", F.coalesce("end", "via")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
