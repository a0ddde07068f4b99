"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b); component is the least node reachable.

    Each round takes the least label among neighbours, then the label's own label, so long chains
    halve. Rounds are written to the shared folder; only a count comes to the driver. Labels are merged, not broadcast: their
    files, full of equal labels, are far smaller than their rows.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = written(labels, "labels")
    while True:
        label = labels.select(F.col("node").alias("b"), "component")
        near = both.join(label.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("had"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        after = least.join(jump.hint("merge"), "to", "left").select("node", "had", F.least("to", "far").alias("component"))
        after = written(after, "labels")
        changed = after.where("had <> component").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
