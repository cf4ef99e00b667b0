"""Reads and targets against k-mers and contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.packing import MOST_PACKED
from ..functions.sequence import revcomp
from ..functions.staging import staged
from .kmers import among, count_kmers, explode_kmers, frequent_pieces


def unique_positions(contigs: DataFrame, k: int) -> DataFrame:
    """kmer, contig, contig_pos, contig_plus of the k-mers that stand once in all contigs (id, seq)."""
    each = explode_kmers(contigs, k, "id").groupBy("kmer").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos", "is_plus")).alias("x"))
    return each.where("n = 1").select("kmer", F.col("x.id").alias("contig"), F.col("x.pos").alias("contig_pos"), F.col("x.is_plus").alias("contig_plus"))


def place(reads: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """read_id, contig, strand (1 or -1), position of the read's first base, by the first k-mer of a read that has a place."""
    hits = explode_kmers(reads, k, "read_id").join(unique_positions(contigs, k), "kmer")
    first = hits.groupBy("read_id").agg(F.min_by(F.struct("contig", "contig_pos", "contig_plus", "pos", "is_plus"), "pos").alias("h")).select("read_id", "h.*")
    same = F.col("is_plus") == F.col("contig_plus")
    at = F.when(same, F.col("contig_pos") - F.col("pos")).otherwise(F.col("contig_pos") + k - 1 + F.col("pos"))
    return first.select("read_id", "contig", F.when(same, 1).otherwise(-1).alias("strand"), at.cast("long").alias("position"))


def deep_reads(reads: DataFrame, contigs: DataFrame, k: int, margin: int) -> DataFrame:
    """read_id of reads that lie in a contig (id, seq, and circular if some may be) with the margin to both of its ends.

    A circular contig has no ends: a read with a place in it is deep.
    """
    ring = F.col("circular") if "circular" in contigs.columns else F.lit(False)
    n = contigs.select(F.col("id").alias("contig"), F.length("seq").alias("clen"), ring.alias("ring"))
    at = place(reads, contigs, k).join(n, "contig").join(reads.select("read_id", F.length("seq").alias("rlen")), "read_id")
    ahead = (F.col("strand") > 0) & (F.col("position") >= margin) & (F.col("position") + F.col("rlen") - 1 < F.col("clen") - margin)
    back = (F.col("strand") < 0) & (F.col("position") - F.col("rlen") + 1 >= margin) & (F.col("position") < F.col("clen") - margin)
    return at.where(F.col("ring") | ahead | back).select("read_id")


def unused_reads(reads: DataFrame, contigs: DataFrame, k: int, margin: int) -> DataFrame:
    """reads of at least k bases that aren't deep inside a contig."""
    return reads.where(F.length("seq") >= k).join(deep_reads(reads, contigs, k, margin), "read_id", "left_anti")


def longest_covered_run(reads: DataFrame, kmers: DataFrame, k: int, low_count: int) -> DataFrame:
    """read_id, start, length of the longest run of bases that k-mers of at least low_count cover, the first of equal ones.

    Such a run is an island of k-mers that begin at most k bases after one another. kmers is read twice.
    """
    good = among(explode_kmers(reads, k, "read_id"), kmers.where(F.col("cnt") >= low_count)).select("read_id", F.col("pos").alias("start"), F.lit(1).alias("n"))
    return _longest_run(good, k)


def longest_counted_run(reads: DataFrame, k: int, low_count: int) -> DataFrame:
    """The same with the k-mers that these reads (read_id: long) have at least low_count times; no window is shuffled alone."""
    if k > MOST_PACKED:
        return longest_covered_run(reads, staged(count_kmers(reads, k, low_count), "kmers"), k, low_count)
    return _longest_run(staged(frequent_pieces(reads, k, low_count), "pieces"), k)


def _longest_run(pieces: DataFrame, k: int) -> DataFrame:
    """pieces: read_id, start, n of windows in a row."""
    order = W.partitionBy("read_id").orderBy("start")
    last = F.max(F.col("start") + F.col("n") - 1).over(order.rowsBetween(W.unboundedPreceding, -1))
    island = pieces.withColumn("_new", F.coalesce(F.col("start") - last > k, F.lit(False))).withColumn("island", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = island.groupBy("read_id", "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n") - 1) - F.min("start") + k).alias("length"))
    best = runs.groupBy("read_id").agg(F.max(F.struct("length", (-F.col("start")).alias("first"))).alias("b"))
    return best.select("read_id", (-F.col("b.first")).cast("long").alias("start"), F.col("b.length").cast("long").alias("length"))


def target_hits(reads: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """read_id, target_id, hits: places of the read's k-mers in the target's, with their multiplicities."""
    # counts on both sides first, so that a common k-mer isn't multiplied out; what no target has isn't counted
    b = explode_kmers(targets, k, "target_id").groupBy("target_id", "kmer").agg(F.count("*").alias("n"))
    a = among(explode_kmers(reads, k, "read_id"), b).groupBy("read_id", "kmer").agg(F.count("*").alias("m"))
    return a.join(b, "kmer").groupBy("read_id", "target_id").agg(F.sum(F.col("m") * F.col("n")).alias("hits"))


def target_seeds(targets: DataFrame, kmers: DataFrame, k: int, least: int = 2) -> DataFrame:
    """target_id, pos, kmer, cnt of a target's k-mers that the graph has at least `least` times."""
    return explode_kmers(targets, k, "target_id").join(kmers.where(F.col("cnt") >= least).select("kmer", "cnt"), "kmer").select("target_id", F.col("pos").cast("long").alias("pos"), "kmer", "cnt")


def best_seeds(targets: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """target_id, pos, cnt of the seed that is frequent and near to the middle, the last of equal ones."""
    seeds = target_seeds(targets, kmers, k).join(targets.select("target_id", F.floor(F.length("seq") / 2).alias("mid")), "target_id")
    score = F.floor(F.col("cnt") * 1000 / (F.abs(F.col("pos") - F.col("mid")) + 1))
    best = seeds.groupBy("target_id").agg(F.max(F.struct(score.alias("score"), "pos", "cnt")).alias("b"))
    return best.select("target_id", "b.pos", "b.cnt")


def mate_overlaps(pairs: DataFrame, shortest: int = 20) -> DataFrame:
    """pair_id, overlap: the longest suffix of mate 1 that begins the reverse complement of mate 2 (pair_id, mate, seq).

    Only suffixes that begin with the first `shortest` bases of the other are compared: mate 1 is cut where these stand.
    """
    both = pairs.groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 1, F.col("seq"))).alias("a"), F.max(F.when(F.col("mate") == 2, revcomp(F.col("seq")))).alias("b"))
    both = both.where((F.length("a") >= shortest) & (F.length("b") >= shortest))
    parts = F.split("a", F.concat(F.lit("(?="), F.left("b", F.lit(shortest)), F.lit(")")))
    sizes = F.reverse(F.transform(parts, F.length))
    suffixes = F.aggregate(sizes, F.array().cast("array<int>"), lambda so_far, n: F.concat(so_far, F.array(n + F.coalesce(F.get(so_far, F.size(so_far) - 1), F.lit(0)))))
    fits = F.filter(suffixes, lambda i: (i >= shortest) & (i <= F.length("b")) & F.col("a").endswith(F.left("b", i)))
    return both.select("pair_id", F.coalesce(F.array_max(fits), F.lit(0)).cast("long").alias("overlap"))


def classify_pairs(pairs: DataFrame, contigs: DataFrame, k: int, margin: int, span: int) -> DataFrame:
    """pair_id, fate, seq of each pair with both mates (pair_id, mate, seq), by where its mates lie in contigs (id, seq).

    deep: a mate and `span` bases on from it lie in a contig with the margin to its ends, or the mates face each other so;
    internal: the mates face each other inside a contig, and seq is what lies between them; kept: all others.
    """
    n = contigs.select(F.col("id").alias("contig"), F.length("seq").alias("clen"))
    reads = pairs.select(F.struct("pair_id", "mate").alias("read_id"), "seq")
    at = place(reads, contigs, k).join(n, "contig").select("read_id.pair_id", "read_id.mate", F.struct("contig", "strand", "position", "clen").alias("x"))
    at = at.groupBy("pair_id").agg(*(F.max(F.when(F.col("mate") == m, F.col("x"))).alias(f"x{m}") for m in (1, 2)))
    both = pairs.groupBy("pair_id").agg(F.count("*").alias("_n"), F.min(F.length("seq")).alias("shortest")).where("_n = 2").join(at, "pair_id", "left")
    a, b, m = F.col("x1"), F.col("x2"), F.lit(margin)

    def deep(x):
        end = x["clen"] - m
        ahead = (x["strand"] > 0) & (x["position"] >= m) & (x["position"] + span - 1 < end)
        return F.coalesce(ahead | (x["strand"] < 0) & (x["position"] - span + 1 >= m) & (x["position"] < end), F.lit(False))

    low, high = (F.when(a["strand"] > 0, f["position"]).otherwise(g["position"]) for f, g in ((a, b), (b, a)))
    facing = F.coalesce((a["contig"] == b["contig"]) & (a["strand"] != b["strand"]), F.lit(False))
    fate = F.when(F.col("shortest") < k, "kept").when(deep(a) | deep(b), "deep").when(facing & (low >= m) & (high < a["clen"] - m), "deep")
    fate = fate.when(facing & (low >= 0) & (high < a["clen"]), "internal").otherwise("kept")
    least, most = F.greatest(F.least(a["position"], b["position"]), F.lit(0)), F.least(F.greatest(a["position"], b["position"]), a["clen"] - 1)
    rows = both.select("pair_id", fate.alias("fate"), F.when(fate == "internal", a["contig"]).alias("id"), (least + 1).cast("int").alias("start"), (most - least + 1).cast("int").alias("n"))
    return rows.join(contigs.select("id", "seq"), "id", "left").select("pair_id", "fate", F.substr("seq", F.col("start"), F.col("n")).alias("seq"))
