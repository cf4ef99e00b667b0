"""How much goes through the disk, and that less of it gives the same results."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.functions.packing import Packing
from strandline.functions.staging import staged
from strandline.operators import graph, kmers, pairs
from strandline.sources import sinks


def on_disk(spark):
    """Bytes of each shuffle file that there is."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data")}


def reads_of(spark, seed, n, length=400):
    draw = random.Random(seed)
    seqs = ["".join(draw.choice("ACGT") for _ in range(length)) for _ in range(n)]
    turned = [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in seqs[: n // 3]]
    return staged(spark.createDataFrame([(i, s) for i, s in enumerate(seqs + [s[:200] for s in seqs] + turned)], "read_id long, seq string"), "reads")


def written(spark, df):
    """Bytes that a query shuffles."""
    before = on_disk(spark)
    df.write.format("noop").mode("overwrite").save()
    return sum(n for f, n in on_disk(spark).items() if f not in before)


def by_join(counts, k, low_count):
    steps = graph.edges(counts, k).where(F.col("cnt") >= low_count)
    slots = [F.max(F.when(F.col("nt") == i, F.col(x))).alias(f"{x[0] if x == 'cnt' else 'f'}{i}") for x in ("cnt", "plus_frac") for i in range(4)]
    return steps.groupBy("src").agg(*slots)


@pytest.mark.parametrize("k", [21, 31])
def test_windows_are_shuffled_as_runs(spark, k):
    reads = reads_of(spark, 1, 1500)
    windows = kmers.explode_kmers(reads, k).count()
    assert written(spark, kmers.count_kmers(reads, k)) < 4 * windows


@pytest.mark.parametrize("k", [3, 11, 21, 29, 30, 31])
def test_runs_in_small_parts_give_the_same_counts(spark, monkeypatch, k):
    reads = spark.createDataFrame([(0, "A" * 900), (1, None), (2, "ACGTNNACGTTGCATTAGGCATTCAGGACTTAGGCANTTAGGCATTCAGGACTTAGGCAT" * 4), (3, "ACGT" * 60), (4, "TTAGG"), (5, "acgtTGCAacgtTGCAccatgACGTTGCAACGTTGCA")], "read_id long, seq string")
    monkeypatch.setattr(kmers, "WINDOWS_AT_ONCE", 100)
    monkeypatch.setattr(kmers, "COUNTED_AT_ONCE", 7)
    each = kmers.explode_kmers(reads, k)
    want = each.groupBy("kmer").agg(F.count("*").alias("cnt"), F.sum(F.col("is_plus").cast("long")).alias("plus"))
    assert sorted(map(tuple, kmers.count_kmers(reads, k).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [2, 3, 4, 5, 20, 21, 31])
@pytest.mark.parametrize("low_count", [1, 2])
def test_forks_at_junctions_are_those_of_the_edges(spark, k, low_count):
    reads = reads_of(spark, k, 20, 60 if k < 9 else 300)
    counts = staged(kmers.count_kmers(reads, k), "kmers")
    got = graph.forks_of(counts, k, low_count)
    assert sorted(map(str, got.select("src", *got.columns[1:]).collect())) == sorted(map(str, by_join(counts, k, low_count).select(*got.columns).collect()))


@pytest.mark.parametrize("k", [4, 5, 21, 31])
def test_unique_edges_are_found_where_they_stand(spark, monkeypatch, k):
    from strandline.operators import junctions

    monkeypatch.setattr(junctions, "AT_ONCE", 10)
    counts = staged(kmers.count_kmers(reads_of(spark, k, 40, 30 if k < 9 else 300), k), "kmers")
    forks = graph.filtered(graph.forks_of(counts, k, 1), k, 0.1, 1)
    assert sorted(map(tuple, graph.unique_edges(forks, k, together=True).collect())) == sorted(map(tuple, graph.unique_edges(forks, k).select("src", "dst").collect()))


def test_unique_edges_shuffle_little(spark):
    reads, k = reads_of(spark, 2, 1500), 21
    before = on_disk(spark)
    counts = staged(kmers.count_kmers(reads, k), "kmers")
    assert not on_disk(spark).keys() - before.keys()  # a staged table leaves no shuffle files
    n = counts.count()
    assert written(spark, graph.unique_edges(graph.filtered(graph.forks_of(counts, k, 1), k, 0.1, 1), k, together=True)) < 35 * n


def test_letters(spark):
    rows = spark.createDataFrame([("ACGTT", 1), ("TTTTT", 2), (None, 3)], "x string, y int").withColumn("kmer", Packing(5).parse(F.col("x")))
    assert all(r["x"] == r["kmer"] for r in kmers.lettered(rows, 5).collect())


def test_longest_counted_runs_equal_those_of_a_table(spark, monkeypatch):
    from strandline.operators import mapping

    monkeypatch.setattr(kmers, "WINDOWS_AT_ONCE", 500)
    draw, k = random.Random(4), 11
    g = "".join(draw.choice("ACGT") for _ in range(600))
    seqs = [g[i : i + draw.choice([5, 40, 200])] + "ACNGT"[: draw.choice([0, 2, 5])] + g[j : j + 60] for i, j in ((draw.randrange(500), draw.randrange(500)) for _ in range(40))]
    rows = [(None if i % 7 == 0 else i // 3, s) for i, s in enumerate(seqs)]  # ids that repeat are one read, also null ones
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    want = mapping.longest_covered_run(reads, kmers.count_kmers(reads, k), k, 2)
    assert sorted(map(str, mapping.longest_counted_run(reads, k, 2).collect())) == sorted(map(str, want.collect()))


def test_longest_runs_shuffle_little(spark):
    from strandline.operators import mapping

    reads = reads_of(spark, 5, 1500)
    windows = kmers.explode_kmers(reads, 21).count()
    assert written(spark, mapping.longest_counted_run(reads, 21, 2)) < 6 * windows


def test_adapters_are_looked_up_without_a_shuffle_of_windows(spark):
    reads = reads_of(spark, 5, 1500)
    assert written(spark, kmers.clip_adapters(reads, 0.05, 15)) < 2 * kmers.explode_kmers(reads, 19).count()


def test_histograms_of_two_k_shuffle_runs(spark):
    reads = reads_of(spark, 6, 1500)
    lines = sinks.graph_histogram_lines({k: kmers.histogram(kmers.count_kmers(reads, k)) for k in (21, 31)})
    assert written(spark, lines) < 8 * kmers.explode_kmers(reads, 21).count()


@pytest.mark.parametrize("few", [1, 3, 100])
def test_steps_near_starts(spark, few):
    steps = staged(spark.createDataFrame([(i, i + 1) for i in range(50)] + [(3, 40), (60, 61), (61, 60)], "src long, dst long"), "steps")
    starts = spark.createDataFrame([(2,), (60,), (99,)], "src long")
    got = {tuple(r) for r in graph.near(starts, steps, 3, few).collect()}
    want = {(2, 3), (3, 4), (4, 5), (3, 40), (40, 41), (60, 61), (61, 60)}
    assert got == want if few >= 100 else got >= want
    assert graph.near(starts.limit(0), steps, 3).select("dst").count() >= 0


def long_line(spark, n=20000):
    return staged(spark.range(n).selectExpr("id as src", "id + 1 as dst"), "steps")


def test_walks_and_searches_from_few_starts_leave_the_steps_where_they_are(spark):
    steps = long_line(spark)
    before = on_disk(spark)
    forked = steps.unionByName(spark.createDataFrame([(7, 9)], "src long, dst long"))
    found = graph.reachable(spark.createDataFrame([(7,)], "src long"), forked, 3)
    assert {tuple(r) for r in found.collect()} == {(7, 8, 1), (7, 9, 1), (7, 10, 2), (7, 11, 3)}
    walks = pairs.walked(spark.createDataFrame([(5,), (19998,)], "node long"), steps, 21)
    assert {tuple(r) for r in walks.select("node", "to", "taken").collect()} == {(5, 26, 21), (19998, 20000, 2)}
    assert sum(n for f, n in on_disk(spark).items() if f not in before) < 50_000


def test_only_the_windows_of_margins_meet_steps(spark, monkeypatch):
    reads, k = reads_of(spark, 8, 400), 21
    forks = staged(graph.forks_of(staged(kmers.count_kmers(reads, k), "kmers"), k, 1), "forks")
    contigs = staged(reads.select(F.col("read_id").alias("id"), "seq", F.lit(40).alias("left_repeat"), F.lit(40).alias("right_repeat")), "contigs")
    monkeypatch.setattr(pairs, "explode_kmers", lambda *x: kmers.explode_kmers(*x).hint("shuffle_merge"))  # small tables would be broadcast
    few = written(spark, pairs.repeat_margins(contigs, forks, k))
    all_of_them = written(spark, pairs.repeat_margins(contigs.withColumns({"left_repeat": F.lit(199), "right_repeat": F.lit(199)}), forks, k))
    assert few < 0.8 * all_of_them
