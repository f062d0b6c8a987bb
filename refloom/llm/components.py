"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from refloom.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b long, a written table): comp is the smallest node of its component.

    Each round takes the smallest label among neighbours (combined before the shuffle, so a
    hub is no single task) and then the label's own label, so chains shorten by half. Rounds
    are written tables: nothing is collected but a count of changes.
    """
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        seen = Observation()
        nxt = lower.join(jump, "comp").select("node", "was", F.least("comp", "far").alias("comp"))
        labels = stage(nxt.observe(seen, F.count_if(F.col("comp") < F.col("was")).alias("n"))).select("node", "comp")
        if not seen.get["n"]:
            return labels


def merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more ``links`` between them (a, b: their smallest nodes, or nodes that had none), each named by its smallest node."""
    step = components(links)
    if known is None:
        return step
    to = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    fresh = step.select("node", F.col("node").alias("comp")).join(known, "node", "left_anti")
    return stage(known.unionByName(fresh).join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
