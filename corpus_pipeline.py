"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents.

Every stage takes texts whole, null and empty ones as texts without words; rows that repeat an id stay rows of their own,
each judged by its own text; further columns stay as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, mixing, quality, simhash, substring_dedup
from strandline.functions.staging import drop, staged_alone
from strandline.llm.common import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels of the documents that there are, doesn't reject.

    Without labels of both kinds all score alike, and all stay, unless all labels are bad.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, null first, of each group of near duplicates.

    Of rows that repeat this id the one of the least hash of its text stays, of equal ones any; empty texts are one group.
    """
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand anywhere else; a text that is nothing but such passages becomes empty.

    Null texts stay null, and n_chars is counted anew.
    """
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; those without words hold none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; of one without words none. A null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("substrings", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Neither the classifier nor the fingerprints can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. Each stage's tables go once it is written, and what it read once the next stage has."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = staged_alone(spark, partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            drop(read)
        docs = read = kept
    return STAGES[-1][1](spark, docs, sf_dir)
