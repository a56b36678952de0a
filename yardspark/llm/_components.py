"""Connected components of a table of links, by rounds of least labels and pointer jumps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardspark.llm._staging import Staging


def components(links: DataFrame, stage: Staging, name: str) -> DataFrame:
    """(node, comp): every end of a link (a, b) with the least node reachable from it.

    Each round takes the least label among a node's neighbours and then the label of that label, so that long chains
    shorten by half; the number of rounds is about the logarithm of the longest chain. Hubs are combined before shuffles.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}_0")
    turn = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        new = new.join(jump, "comp").select("node", "was", F.least("comp", "to").alias("comp"))
        turn += 1
        new = stage.put(new, f"{name}_{turn}")
        stage.drop(f"{name}_{turn - 1}")
        labels = new.select("node", "comp")
        if new.filter(F.col("was") != F.col("comp")).isEmpty():
            return labels
