"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) of longs: component is the smallest node it can reach.

    Each round hooks larger neighbours to the smallest one (large star), then smaller ones (small star); rounds are of
    the order of the logarithm of the longest path. Work and rows per round stay within twice the number of edges, and
    the table is written to the shared folder after every round.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    count, total = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # v's least neighbour m (itself included); every larger neighbour u hooks to m
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(down.select("v", F.col("m").alias("u"))).distinct()
        now = cut(small)
        new = _state(now)
        if new == (count, total):
            break
        count, total = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    # exact sums of the ends: the table only ever moves to smaller ends, so equal counts and sums mean no change
    row = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)"))).first()
    return row[0], (row[1], row[2])
