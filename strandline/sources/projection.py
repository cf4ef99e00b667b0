"""Nucleotide projection of ordinary text tables: the letter number i of the alphabet becomes ACGT[i mod 4]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[i % 4] for i in range(26))


def project(text: Column) -> Column:
    """All letters of the text as bases; other characters are left out."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS + LETTERS.upper(), BASES + BASES)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores; a table of fewer row groups would be read by fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(F.col("doc_id").alias("read_id"), project(F.col("text")).alias("seq"))


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 0 and 1, 2 and 3, ... of a conversation as pairs: pair_id (conv_id:number), mate (1 or 2), seq.

    An odd last turn is a mate without a partner.
    """
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    pair = F.concat_ws(":", F.col("conv_id"), F.floor(F.col("turn") / 2))
    return turns.select(pair.alias("pair_id"), (F.col("turn") % 2 + 1).cast("int").alias("mate"), project(F.col("text")).alias("seq"))


def fragments(spark: SparkSession, sf_dir: str, size: int = 300, read: int = 100) -> DataFrame:
    """Pairs as from fragments of the documents, cut one behind the other: pair_id (doc_id:number), mate, seq.

    Mate 1 is the beginning of a fragment of `size` bases, mate 2 the reverse complement of its end; what is left of a
    document at the end is none.
    """
    rows = documents(spark, sf_dir).withColumn("n", F.floor(F.length("seq") / size).cast("int")).where("n > 0")
    rows = rows.select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    end = F.reverse(F.translate(F.substr("seq", F.col("i") * size + size - read + 1, F.lit(read)), "ACGT", "TGCA"))
    each = F.array(F.struct(F.lit(1).alias("mate"), F.substr("seq", F.col("i") * size + 1, F.lit(read)).alias("seq")), F.struct(F.lit(2).alias("mate"), end.alias("seq")))
    return rows.select(F.concat_ws(":", "read_id", "i").alias("pair_id"), F.inline(each))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("target_id"), project(F.col("text")).alias("seq"))
