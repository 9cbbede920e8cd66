"""Connected components by contraction: every node joins its smallest neighbour until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.spread import attach, written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a long, b long): root is the smallest node of its component.

    Each round relabels links by the smallest neighbour and drops those within one label, so links shrink quickly. Hot nodes and roots only
    take part in aggregates that combine before the shuffle, and their labels are attached without a shuffle by them.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("root")))
    size, n = labels.count(), links.count()
    while n:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"), F.count(F.lit(1)).alias("links"))
                       .select(F.col("a").alias("node"), "to", "links"))
        uses = near.groupBy("to").agg(F.count(F.lit(1)).alias("uses"))
        hop = near.select(F.col("node").alias("to"), F.col("to").alias("to2")).join(uses, "to")  # a second hop halves the rounds
        step = written(attach(near, hop, "to", "uses", size).select("node", F.coalesce("to2", "to").alias("to"), "links"))
        members = labels.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        moved = step.select(F.col("node").alias("root"), "to").join(members, "root")
        labels = written(attach(labels, moved, "root", "members", size)
                         .select("node", F.coalesce("to", "root").alias("root")))
        for end in ("a", "b"):
            links = attach(links, step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"), "links"), end, "links", n).drop("links")
        links = written(links.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        n = links.count()
    return labels
