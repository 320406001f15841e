"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp: the smallest node that each node of edges (a, b) reaches; a written table.

    Each round takes the smallest label among a node's neighbours and then the label that this one had. The links of a hot
    node are pre-aggregated where they lie and met by a join whose large partitions split. Labels are written every
    round, so a lost executor costs no more than a round.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct(), f"{name}-0")
    turn = 0
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = step.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp")
        new = scratch.save(jump.select("node", "old", F.col("further").alias("comp")), f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}")
        labels, turn = new.select("node", "comp"), turn + 1
        if new.filter("comp <> old").isEmpty():
            return labels
