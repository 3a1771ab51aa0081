"""Connected components of a link table, by minimum labels with pointer jumping. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (u, v): the least node of its component. Each round is a written table."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = written(both, "cc-links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        best = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = best.join(at, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = written(new, "cc-labels")
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels
