"""Connected components of a graph given as a table of links, by alternating stars.

Each round hangs all larger neighbours of a node on its smallest one (large star), then all smaller
ones (small star). Both are a minimum over a window of the node's links, which Spark sorts and spills, so
none are held whole in memory, and the links end as stars around the smallest node of every component. Rounds
are cut by written tables. The driver keeps a record of every task, so a round is three shuffles, stars are
recognised without a round that changes nothing, and a graph that has grown goes on from the stars it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


def _round(links: DataFrame) -> DataFrame:
    """Large and small star of links with a > b; theirs are again such."""
    own = Window.partitionBy("a")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = both.withColumn("m", F.least("a", F.min("b").over(own))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = large.withColumn("m", F.min("b").over(own))
    return small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether no node hangs on two others, or on one that hangs itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).where("n > 1").agg(F.count("*")).first()[0]


def stars(links: DataFrame) -> DataFrame:
    """(a, b), a written table: each node of a component but the smallest, with the smallest; links: (a, b) longs, in any order, repeats allowed."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not _are_stars(now):
        last, now = now, materialize(_round(now), "links")
        discard(last)
    return now


def members(stars: DataFrame) -> DataFrame:
    """(node, root) for every node of the stars."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; links: (a, b) longs, in any order, repeats allowed."""
    return members(stars(links))
