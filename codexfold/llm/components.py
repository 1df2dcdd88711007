"""Connected components of a link table, as joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b).

    Nodes without a link are absent. Every round takes the smallest label among
    the neighbours and then the label of that label; the only thing the driver
    sees is the count of changed labels.
    """
    both = written(
        links.where("a != b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*").distinct()
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"node": "b", "component": "seen"}), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("top"))
        moved = written(step.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("top", "to")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("was != component").isEmpty():
            return labels
