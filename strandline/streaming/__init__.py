"""K-mer counts of reads that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import count_kmers, histogram


def streaming_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer, cnt, plus of a stream of reads (seq), kept in the state store; for the modes update and complete."""
    return count_kmers(reads, k)


def partial_counts(reads: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's k-mers (kmer, cnt, plus) to `path`; counts are sums, so readers add them up."""

    def write(batch: DataFrame, epoch: int) -> None:
        count_kmers(batch, k).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch replaces itself

    return reads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def histogram_so_far(spark: SparkSession, path: str) -> DataFrame:
    """count, freq of all reads that partial_counts has appended to `path` by now; added up when it is asked for."""
    parts = spark.read.parquet(path).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return histogram(parts)


__all__ = ["histogram_so_far", "partial_counts", "streaming_counts"]
