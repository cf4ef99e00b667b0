"""Global ranks and running sums without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged


def cumulated(df: DataFrame, sums: dict[str, Column], *order: str | Column) -> DataFrame:
    """df with a column for each of `sums`: the sum of that column over this row and all before it in the order given.

    Rows are dealt into ranges, summed up in their range, and moved on by the sums of the ranges before: one row a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {f"_own_{name}": value for name, value in sums.items()}
    dealt = staged(df.withColumns(own).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("_range").agg(*(F.sum(f"_own_{name}").alias(f"_all_{name}") for name in sums))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_range", *(F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums))
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_own_{name}": F.sum(f"_own_{name}").over(within) for name in sums}).join(F.broadcast(ranges), "_range")
    return rows.select(*df.columns, *((F.col(f"_own_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums))


def ranked_rows(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with `name`: the place of a row (from 1) in this order, which should tell all rows apart."""
    return cumulated(df, {name: F.lit(1)}, *order)
