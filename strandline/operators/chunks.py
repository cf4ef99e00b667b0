"""Contigs as chunks: a list of lists of strings, where a chunk of one string is plain and one of several is a variation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import revcomp


def length_min(chunks: Column) -> Column:
    return _sum(F.transform(chunks, lambda c: F.array_min(F.transform(c, F.length))))


def length_max(chunks: Column) -> Column:
    return _sum(F.transform(chunks, lambda c: F.array_max(F.transform(c, F.length))))


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0)))


def primary(chunks: Column) -> Column:
    """The sequence of each chunk's first string."""
    return F.array_join(F.transform(chunks, lambda c: F.get(c, 0)), "")


def reversed_chunks(chunks: Column) -> Column:
    """The chunks of the reverse complement."""
    return F.reverse(F.transform(chunks, lambda c: F.transform(c, revcomp)))


def expanded(chunks: Column) -> Column:
    """All sequences that a contig stands for: each variation's strings combined with those of all others, in order."""
    start = F.array(F.lit(""))
    return F.aggregate(chunks, start, lambda so_far, c: F.flatten(F.transform(so_far, lambda s: F.transform(c, lambda v: F.concat(s, v)))))


def seed_chunks(seq: Column) -> Column:
    """A seed's chunks: codes that stand for several bases are variations, the rest is plain."""
    from ..functions.sequence import expand_iupac

    parts = F.regexp_extract_all(seq, F.lit("[ACGT]+|[^ACGT]"), F.lit(0))
    return F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[ACGT]+$")), F.array(p)).otherwise(F.split(expand_iupac(p), "")))


def placed(contigs: DataFrame) -> DataFrame:
    """number, i, start, before, primary, after, variants of the variations of contigs (number, chunks).

    start: bases of the first strings of all chunks before, which is where a variation begins in the contig's primary
    sequence; before and after: the first strings of the chunks beside it, empty where there are none.
    """
    rows = contigs.select("number", F.posexplode("chunks").alias("i", "variants")).withColumn("primary", F.coalesce(F.get("variants", F.lit(0)), F.lit("")))
    order = W.partitionBy("number").orderBy("i")
    up_to = F.sum(F.length("primary")).over(order.rowsBetween(W.unboundedPreceding, -1))
    beside = lambda f: F.coalesce(f("primary").over(order), F.lit(""))
    rows = rows.withColumns({"start": F.coalesce(up_to, F.lit(0)).cast("int"), "before": beside(F.lag), "after": beside(F.lead)})
    return rows.where(F.size("variants") > 1).select("number", "i", "start", "before", "primary", "after", "variants")
