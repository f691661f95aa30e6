"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from statuta.llm.store import discard, materialise


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component for each node of links (x, y); component is its smallest node.

    Each round gives a node the smallest label among its own, its neighbours'
    and its label's label, so stars settle at once and chains halve.  A hub's
    edges are one key of a plain join, which the adaptive planner splits.
    """
    edges = materialise(links.select("x", "y").union(links.select("y", "x")).distinct(), "component-edges")
    labels = materialise(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "component-labels")
    for _ in range(most_rounds):
        heard = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("component").alias("heard"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("jumped"))
        seen = Observation()
        step = (
            labels.join(heard, labels.node == heard.x, "left")
            .join(jump, F.col("component") == F.col("at"), "left")
            .select("node", F.least("component", "heard", "jumped").alias("component"), F.col("component").alias("was"))
            .observe(seen, F.count_if(F.col("component") != F.col("was")).alias("changed"))
        )
        step = materialise(step.drop("was"), "component-labels")
        discard(labels)
        labels = step
        if not seen.get["changed"]:
            discard(edges)
            return labels
    raise RuntimeError("components did not settle")
