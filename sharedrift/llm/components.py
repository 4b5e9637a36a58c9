"""Connected components of a graph that fits no single machine: alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharedrift.sources.tables import written_once


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: ``root`` is the smallest node reachable.  ``edges``: any two columns of one
    ordered type; repeated, reversed and self edges do no harm.  Each round is a written table, so a lost executor costs a
    re-read; the number of rounds grows with the logarithm of the longest chain."""
    a, b = edges.columns
    stars = written_once(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    before = None
    while (state := _state(stars)) != before:
        before = state
        if state[0]:
            stars = written_once(_small_star(_large_star(stars)))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select("b", "b").distinct())
