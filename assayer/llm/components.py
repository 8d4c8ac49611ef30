"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, sorted_join


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """links(a, b) -> (node, component): the least node that can be reached, for each node that has a link.

    Each round takes the least label among neighbours and then the label's own
    label, so paths halve and rounds grow with the logarithm of the longest.
    Labels are written after each round; no links reach the driver.
    """
    both = work.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-links")
    labels = work.write(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(sorted_join(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        own = labels.join(sorted_join(near), labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        merged = own.join(sorted_join(jump), own["new"] == jump["at"]).select("node", "old", F.least("new", "further").alias("component"))
        merged = work.write(merged, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        labels = merged.select("node", "component")
        if not merged.where("component <> old").limit(1).count():
            work.drop(f"{name}-links")
            return labels
