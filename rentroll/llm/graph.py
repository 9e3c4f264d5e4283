"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentroll.session import durable

ROUNDS = 60  # far above the logarithm of any table's longest path


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges as (node, component): the smallest node that each node of an edge can reach.

    Rounds of two steps, each one aggregation (partial before its shuffle) and one join that adaptive execution may
    split: every node's larger neighbours are tied to its smallest neighbour, then its smaller neighbours and the
    node itself are. Ends when the edges form stars. Every round is written to the shared folder. Loops and repeated
    edges are harmless; no edges give no rows.
    """
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    star = durable(star, "edges")
    before = None
    for _ in range(ROUNDS):
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        star = durable(tied.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    member = star.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return member.union(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
