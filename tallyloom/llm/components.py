"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Each round links the neighbours of every node to the smallest of them. Minima are aggregated before they are shuffled and
    written; so both sides of the join of links with minima are plain shuffles, and adaptive execution can split a hot hub.
    Rounds end when every node has one link, to a node that has none.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(MOST_ROUNDS):
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 0)").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "links")
        low = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        small = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError("components didn't settle")
