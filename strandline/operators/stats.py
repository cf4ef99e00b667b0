"""Assembly statistics over lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cumulated(lengths: DataFrame) -> DataFrame:
    """length, n, up_to (bases of this and all longer lengths), rank (sequences so far), total; one row a length."""
    by = lengths.where("length > 0").groupBy("length").agg(F.count("*").alias("n"))
    down = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bases = F.col("length") * F.col("n")
    return by.withColumns({"up_to": F.sum(bases).over(down), "rank": F.sum("n").over(down), "total": F.sum(bases).over(total)})


def _at(part: float) -> Column:
    """The length at which the longest sequences hold `part` of all bases (rounded down)."""
    return F.max(F.when(F.col("up_to") >= F.floor(F.col("total") * part), F.col("length"))).cast("long")


def _rank(part: float) -> Column:
    """How many of the longest sequences hold `part` of all bases (rounded down)."""
    need, before = F.floor(F.col("total") * part), F.col("up_to") - F.col("length") * F.col("n")
    at = F.col("rank") - F.col("n") + F.greatest(F.ceil((need - before) / F.col("length")), F.lit(1))
    return F.min(F.when(F.col("up_to") >= need, at)).cast("long")


def nxx(lengths: DataFrame, part: float, name: str) -> DataFrame:
    """The length at which the longest sequences hold `part` of all bases (rounded down), as one row."""
    return _cumulated(lengths).agg(_at(part).alias(name))


def lxx(lengths: DataFrame, part: float, name: str) -> DataFrame:
    """How many of the longest sequences hold `part` of all bases (rounded down), as one row."""
    return _cumulated(lengths).agg(_rank(part).alias(name))


def report(lengths: DataFrame) -> DataFrame:
    """sequences, total, longest, shortest, average, n50, l50, n90, l90 as one row, from one pass over the lengths."""
    total = F.sum(F.col("length") * F.col("n"))
    plain = [F.sum("n").alias("sequences"), total.alias("total"), F.max("length").cast("long").alias("longest"), F.min("length").cast("long").alias("shortest"), (total / F.sum("n")).alias("average")]
    return _cumulated(lengths).agg(*plain, *(f(part).alias(f"{name}{round(100 * part)}") for part in (0.5, 0.9) for f, name in ((_at, "n"), (_rank, "l"))))
