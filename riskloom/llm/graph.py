"""Connected components of a link table, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.blocks import release
from riskloom.storage import materialise, scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b); nodes are hashes, a label is one of them.

    Each round every node takes the smallest node next to it and links are renamed, which merges a
    constant share of the nodes as their order is random. Links within a merged node vanish, so
    stars and chains alike are done in a few rounds. A hot node's links combine before they move.
    """
    with scratch(links.sparkSession, keep=("components",)):
        edges = materialise(links.where("a <> b").distinct(), "links")
        labels = materialise(
            edges.select(F.col("a").alias("node"))
            .union(edges.select("b"))
            .distinct()
            .withColumn("label", F.col("node")),
            "labels",
        )
        while not edges.isEmpty():
            both = edges.union(edges.select("b", "a"))
            near = both.groupBy("a").agg(F.min("b").alias("m"))
            near = near.select(F.col("a").alias("from"), F.least("a", "m").alias("to"))
            near = materialise(near, "near")
            labels = materialise(
                labels.join(near, labels["label"] == near["from"], "left").select(
                    "node", F.coalesce("to", "label").alias("label")
                ),
                "labels",
            )
            left = near.select(F.col("from").alias("a"), F.col("to").alias("x"))
            right = near.select(F.col("from").alias("b"), F.col("to").alias("y"))
            renamed = edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            edges = materialise(renamed.where("a <> b").distinct(), "links")
            release(edges.sparkSession)
        return materialise(labels, "components")
