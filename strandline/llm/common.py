"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id while rows are grouped; it sorts before any other id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if more than one row in so many has it; so there are fewer hot keys than this.
HOT = 1000


def join_hot(rows: DataFrame, named: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with named (one row a key), where a key may hold any part of the rows.

    n: the column of named that says how many of all `total` rows have the key. Hot keys, fewer than HOT, are broadcast,
    and their rows stay where they are; the others are shuffled. rows is read twice, so it should be a table.
    """
    hot = F.broadcast(named.where(F.col(n) * HOT > total))
    cold = rows.join(hot.select(key), key, "left_anti").join(named.where(F.col(n) * HOT <= total), key)
    return rows.join(hot, key).unionByName(cold).drop(n)


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one in HOT of all rows has, fewer than HOT of them; staged."""
    total = rows.count()
    return staged(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total).select(*keys), "hot-keys")


def join_salted(rows: DataFrame, named: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with named (one row a key) where keys, none null, may hold any part of the rows.

    hot: those of hot_keys. Their rows are dealt over all partitions, and their rows of named, which may be large and so
    aren't broadcast, go to each of them; there are fewer than HOT.
    """
    salts = shuffle_partitions(rows.sparkSession)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    rows = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0)).drop("_hot")
    named = named.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return rows.join(named, [*keys, "_salt"], how).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; all other letters stay."""
    return F.translate(text, UPPER, LOWER)


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def id_of(key: Column) -> Column:
    return F.when(key != NO_ID, key)


__all__ = ["HOT", "LOWER", "NO_ID", "UPPER", "ascii_lower", "hot_keys", "id_of", "join_hot", "join_salted", "key_of", "shuffle_partitions", "staged", "table"]
