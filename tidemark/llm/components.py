"""Connected components of a table of links, by labels that shrink to the smallest node reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b), longs without nulls: the smallest node of its component.

    Each turn a node takes the smallest label of its neighbours, then its
    label's label, so a path of n links needs about log n turns.  Repeated
    links and links of a node with itself change nothing; no links, no rows.
    """
    links = written(links.select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pulled = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(pulled.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if labels.filter("label < old").isEmpty():
            return labels.select("node", "label")
