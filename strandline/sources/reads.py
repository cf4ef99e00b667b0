"""FASTA and FASTQ files as DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import ranked_rows
from ..functions.sequence import longest_clean_run, valid_symbols
from ..functions.staging import staged


def _checked(seq: Column) -> Column:
    return F.when(valid_symbols(seq), seq).otherwise(F.raise_error(F.concat(F.lit("Invalid symbol in sequence: "), F.substring(seq, 1, 60))))


def read_fasta(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """file, ordinal (place of the record in its file), read_id (up to a blank), seq (lines joined). Gzip goes by the suffix.

    strict: an empty id, a header without a sequence and a foreign symbol are errors. Else the whole header is the name and
    records without a sequence are left out, as for targets.
    """
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value")
    parts = parts.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^>", ""), r"\r", "")).where(F.trim("value") != "")
    head, body = F.regexp_extract("value", r"^([^\n]*)", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\n", "")
    if not strict:
        return parts.select("file", "ordinal", F.trim(head).alias("read_id"), F.upper(F.trim(body)).alias("seq")).where("seq <> ''")
    name = F.regexp_extract(head, r"^([^ \t]*)", 1)
    name = F.when(name != "", name).otherwise(F.raise_error(F.lit("Empty record id")))
    body = F.when(body != "", _checked(body)).otherwise(F.raise_error(F.concat(F.lit("No sequence after header: "), head)))
    return parts.select("file", "ordinal", name.alias("read_id"), body.alias("seq"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 0), value. A file is read in blocks; its lines are counted per block and moved on by those before."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = staged(rows, "lines")
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", before.alias("start"))
    within = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("within", within).join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("within")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ordinal, read_id, seq of four-line records; the third line must begin with a plus sign.

    Blank lines at the end of a file don't count. Files of any size are read in parallel, unless they are compressed.
    """
    lines = _lines(spark, path).select("file", F.floor(F.col("line") / 4).alias("ordinal"), (F.col("line") % 4).alias("i"), F.regexp_replace("value", r"\r", "").alias("value"))
    each = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"l{i}") for i in range(4)]
    records = lines.groupBy("file", "ordinal").agg(*each).where("coalesce(l0, '') <> '' or coalesce(l1, '') <> ''")
    good = F.col("l0").startswith("@") & F.coalesce(F.col("l2").startswith("+"), F.lit(False)) & F.col("l3").isNotNull()
    head = F.when(good, F.col("l0")).otherwise(F.raise_error(F.concat(F.lit("Invalid FASTQ record "), F.col("ordinal").cast("string"))))
    return records.select("file", F.col("ordinal").cast("long"), F.regexp_extract(head, r"^@([^ \t]*)", 1).alias("read_id"), _checked(F.col("l1")).alias("seq"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ, by the first letter of the file."""
    first = spark.read.text(path).limit(1).first()
    kind = (first[0] if first else "")[:1]
    if kind not in (">", "@"):
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    return (read_fasta if kind == ">" else read_fastq)(spark, path)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of several files of either format; a file that is named twice counts once, and no records are an error."""
    distinct = sorted(set(paths))
    if len(distinct) < len(paths):
        warnings.warn("input files are named more than once", stacklevel=2)
    rows = reduce(DataFrame.unionByName, [read_any(spark, p) for p in distinct])
    if not rows.limit(1).count():
        raise ValueError("no reads in the input files")
    return rows


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, read_id, seq of seeds: upper-case bases and codes only; an empty file has none."""
    rows = read_fasta(spark, path, strict=False)
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "").select(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"[\r\n]", "").alias("s"))
    if raw.where(F.rlike("s", F.lit("[^ACGTYRWSKMDVHBN]"))).limit(1).count():
        raise ValueError(f"{path}: invalid seeds")
    return rows


def from_memory(spark: SparkSession, singles: Iterable[str | bytes] = (), pairs: Iterable[tuple[str | bytes, str | bytes]] = ()) -> DataFrame:
    """read_id, pair_id, mate, seq of sequences that a program holds; bytes that aren't UTF-8 are empty."""

    def text(seq: str | bytes) -> str:
        if isinstance(seq, str):
            return seq
        try:
            return seq.decode()
        except UnicodeDecodeError:
            return ""

    rows = [(f"pair{i}", i, m, text(s)) for i, both in enumerate(pairs) for m, s in enumerate(both, 1)]
    rows += [(f"single{i}", None, None, text(s)) for i, s in enumerate(singles)]
    return spark.createDataFrame(rows, "read_id string, pair_id long, mate int, seq string")


def clean(reads: DataFrame) -> DataFrame:
    """seq becomes its longest run of ACGT; reads without one are left out."""
    return reads.withColumn("seq", longest_clean_run(F.col("seq"))).where("seq <> ''")


def pair_interleaved(reads: DataFrame) -> DataFrame:
    """pair_id (null: unpaired) and mate added: neighbours of a file whose ids are equal or end in 1 and 2 behind . or /.

    In a run of records that could pair with both neighbours, the first takes the second, the third the fourth.
    """
    order = W.partitionBy("file").orderBy("ordinal")
    stem, end = F.regexp_extract("read_id", r"^(.*)[./][12]$", 1), F.regexp_extract("read_id", r"[./]([12])$", 1)
    rows = reads.withColumns({"_stem": stem, "_end": end})
    rows = rows.withColumns({"_last": F.lag("read_id").over(order), "_last_stem": F.lag("_stem").over(order), "_last_end": F.lag("_end").over(order)})
    joins = (F.col("read_id") == F.col("_last")) | ((F.col("_end") == "2") & (F.col("_last_end") == "1") & (F.col("_stem") == F.col("_last_stem")) & (F.col("_stem") != ""))
    rows = rows.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(order))
    in_run = W.partitionBy("file", "_run").orderBy("ordinal")
    rows = rows.withColumns({"_n": F.row_number().over(in_run) - 1, "_size": F.count("*").over(W.partitionBy("file", "_run"))})
    paired = (F.col("_n") % 2 == 1) | (F.col("_n") + 1 < F.col("_size"))
    pair = F.when(paired, F.concat_ws(":", "file", "_run", F.floor(F.col("_n") / 2)))
    return rows.withColumns({"pair_id": pair, "mate": F.when(paired, (F.col("_n") % 2 + 1).cast("int"))}).drop("_stem", "_end", "_last", "_last_stem", "_last_end", "_joins", "_run", "_n", "_size")


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two files zipped by the order of their records; a longer first file is an error, the rest of a longer second is left out."""
    a, b = (ranked_rows(df, "pair_id", "file", "ordinal").withColumn("pair_id", F.col("pair_id") - 1) for df in (first, second))
    both = a.select("pair_id", "read_id", F.col("seq").alias("s1")).join(b.select("pair_id", F.col("seq").alias("s2")), "pair_id", "left")
    s2 = F.when(F.col("s2").isNotNull(), F.col("s2")).otherwise(F.raise_error(F.lit("The first mate file is longer than the second")))
    mates = F.array(F.struct(F.lit(1).alias("mate"), F.col("s1").alias("seq")), F.struct(F.lit(2).alias("mate"), s2.alias("seq")))
    return both.select("pair_id", "read_id", F.explode(mates).alias("m")).select("pair_id", "read_id", "m.mate", "m.seq")


def demote(pairs: DataFrame) -> DataFrame:
    """A mate whose partner is empty becomes unpaired (a null pair_id); empty reads go. pairs: pair_id, mate, seq."""
    whole = pairs.groupBy("pair_id").agg(F.sum(F.when(F.col("seq") != "", 1).otherwise(0)).alias("_n")).withColumnRenamed("pair_id", "_pair")
    kept = pairs.where("seq <> ''").join(whole, F.col("pair_id") == F.col("_pair"), "left")
    both = F.col("_n") == 2
    return kept.withColumns({"pair_id": F.when(both, F.col("pair_id")), "mate": F.when(both, F.col("mate"))}).drop("_n", "_pair")
