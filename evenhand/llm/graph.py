"""Connected classes of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, root for the nodes of links (a, b): the root is the class's smallest node.

    Each round every node takes the smallest neighbour as its label, links are redrawn between labels, and the rounds end when
    none is left; the links shrink from round to round. Minima are partial aggregates, so a hub is no hot task; joins on a
    hub are plain equi-joins on written tables, which adaptive execution splits.
    """
    links = written(links.where(F.col("a") != F.col("b")).distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        to = written(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")), "labels")
        rounds.append(to)
        one = links.join(to.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        two = one.join(to.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where(F.col("la") != F.col("lb"))
        links = written(two.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for to in rounds[1:]:
        out = out.join(to.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return out.select("node", F.col("label").alias("root"))
