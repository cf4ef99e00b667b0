"""Connected components of a graph that only executors hold, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, staged


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both.where("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Of edges u > v. n: how many, or less."""
    edges = staged(edges, "large-star")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(edges, least, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(2**31 - 1))), F.bit_xor(h)).first())


def smallest_reachable(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) for each node u that reaches a smaller one, where v is the smallest that it reaches.

    edges: u, v (longs, any direction, repeats and loops allowed). Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the nodes. A node of very many edges isn't moved to one task.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(now, label)
    mark = _mark(now)
    while True:
        now = staged(_small_star(_large_star(now, mark[0]), mark[0]), label)
        before, mark = mark, _mark(now)
        if mark == before:
            return now
