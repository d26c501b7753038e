"""Connected components of links between 64-bit nodes, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.shared import write_table


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): for every node of a link (a, b) the smallest node it can reach.

    Each round every node takes the smallest label among its neighbours (a minimum with
    map-side combine), then the label of its label, so the distance that a label travels
    doubles. Every round is written to the shared folder; nothing comes to the driver but
    the number of labels that changed. No links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = write_table(both.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), f"{name}-edges")
    labels = write_table(
        edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
        f"{name}-labels",
    )
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("label")
        )
        spread = write_table(spread, f"{name}-spread")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = write_table(
            spread.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")), f"{name}-labels"
        )
        if not new.filter("label <> was").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
