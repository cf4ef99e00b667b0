import gzip
import random

import pytest

from strandline.operators import kmers
from strandline.sources import reads, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_fasta_joins_lines_and_cuts_the_id(spark, tmp_path):
    path = write(tmp_path / "a.fasta", ">r1 first\nACGT\nAC\n>r2\ttab\nnnAC-GTxA\n")
    assert rows(reads.read_fasta(spark, path), "read_id", "seq") == [("r1", "ACGTAC"), ("r2", "nnAC-GTxA")]
    assert rows(reads.clean(reads.read_fasta(spark, path)), "read_id", "seq") == [("r1", "ACGTAC"), ("r2", "AC")]


def test_gzip_goes_by_the_suffix(spark, tmp_path):
    with gzip.open(tmp_path / "a.fasta.gz", "wt") as f:
        f.write(">x\nACGT\n")
    assert rows(reads.read_any(spark, str(tmp_path / "a.fasta.gz")), "read_id", "seq") == [("x", "ACGT")]


@pytest.mark.parametrize("text", [">a\nACGZ\n", ">a\nAC GT\n", "> \nACGT\n", ">a\n>b\nACGT\n"])
def test_bad_fasta_is_an_error(spark, tmp_path, text):
    with pytest.raises(Exception, match="Invalid|Empty|No sequence"):
        reads.read_fasta(spark, write(tmp_path / "a.fasta", text)).collect()


def test_fastq_takes_quality_for_what_it_is(spark, tmp_path):
    path = write(tmp_path / "a.fastq", "@q1 x\nACGT\n+\n@@@@\n@q2\nGGNA\n+q2\n+@+@\n")
    assert rows(reads.clean(reads.read_any(spark, path)), "read_id", "seq") == [("q1", "ACGT"), ("q2", "GG")]
    with pytest.raises(Exception, match="Invalid FASTQ"):
        reads.read_fastq(spark, write(tmp_path / "b.fastq", "@q1\nACGT\nACGT\n@@@@\n")).collect()


def test_neighbours_pair(spark, tmp_path):
    ids = ["a/1", "a/2", "b.1", "c.1", "c.2", "d", "d", "d", "e/2", "e/1"]
    path = write(tmp_path / "a.fasta", "".join(f">{i}\nACGT\n" for i in ids))
    got = [(r["read_id"], r["mate"]) for r in reads.pair_interleaved(reads.read_fasta(spark, path)).orderBy("ordinal").collect()]
    assert got == [("a/1", 1), ("a/2", 2), ("b.1", None), ("c.1", 1), ("c.2", 2), ("d", 1), ("d", 2), ("d", None), ("e/2", None), ("e/1", None)]


def test_mate_files_by_order(spark):
    first = spark.createDataFrame([("f", 0, "a", "AC"), ("f", 1, "b", "GT")], "file string, ordinal long, read_id string, seq string")
    second = spark.createDataFrame([("g", 0, "a", "TT"), ("g", 1, "b", ""), ("g", 2, "c", "CC")], "file string, ordinal long, read_id string, seq string")
    pairs = reads.pair_files(first, second)
    assert rows(pairs, "pair_id", "mate", "seq") == [(0, 1, "AC"), (0, 2, "TT"), (1, 1, "GT"), (1, 2, "")]
    assert rows(reads.demote(pairs), "pair_id", "mate", "seq") == [(None, None, "GT"), (0, 1, "AC"), (0, 2, "TT")]
    with pytest.raises(Exception, match="longer"):
        reads.pair_files(second, first).collect()


def counted(seqs, k):
    order = str.maketrans("ACTG", "0123")
    out = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            rc = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
            plus = w.translate(order) < rc.translate(order)
            cnt, n = out.get(w if plus else rc, (0, 0))
            out[w if plus else rc] = cnt + 1, n + plus
    return {(w, *x) for w, x in out.items()}


@pytest.mark.parametrize("k", [1, 4, 5, 21, 31, 32, 33])
def test_counts_equal_brute_force(spark, k):
    draw = random.Random(k)
    seqs = ["".join(draw.choice("ACGT") for _ in range(draw.choice([0, 3, 40, 700]))) for _ in range(30)] + ["A" * 300]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")
    assert {tuple(r) for r in kmers.lettered(kmers.count_kmers(df, k), k).collect()} == counted(seqs, k)


def test_histogram_and_number_forms(spark):
    hist = spark.createDataFrame([(2, 5), (1, 7)], "count long, freq long")
    assert [r[0] for r in sinks.histogram_lines(hist).collect()] == ["1\t7", "2\t5"]
    numbers = spark.createDataFrame([(4.0,), (4.021131,), (1234567.0,), (0.5,)], "x double")
    assert [r[0] for r in numbers.select(sinks.six_digits(numbers.x)).collect()][:2] == ["4", "4.02113"]


def test_adapters_are_cut(spark):
    adapter, draw = "ACGTTGCAAGGCTTAACCA", random.Random(1)
    seqs = ["".join(draw.choice("ACGT") for _ in range(10)) + adapter + "GG" for _ in range(20)] + [adapter + "A"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")
    assert {r["seq"] for r in kmers.clip_adapters(df, 0.5, 15).collect()} == {s[:10] for s in seqs[:20]}


def test_spectrum_of_a_clear_peak():
    freq = [900, 400, 150, 60, 20, 30, 80, 200, 500, 900, 1200, 900, 500, 200, 80, 30, 10]
    bins = list(enumerate(freq, 1))
    valley, last = kmers.main_range(bins)
    assert valley == 4 and last >= 10
    assert kmers.main_range([(1, 5)]) == (-1, 0)
    assert kmers.thresholds(200.0, 2) == (4, 20)


def test_lines_of_several_blocks_keep_their_order(spark, tmp_path):
    n = 3000
    path = write(tmp_path / "a.fastq", "".join(f"@r{i}\n{'ACGT'[i % 4] * (i % 50 + 1)}\n+\n{'@' * (i % 50 + 1)}\n" for i in range(n)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = [tuple(r) for r in reads.read_fastq(spark, path).orderBy("ordinal").select("ordinal", "read_id", "seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"r{i}", "ACGT"[i % 4] * (i % 50 + 1)) for i in range(n)]


def test_files_seeds_and_memory(spark, tmp_path):
    a, b = write(tmp_path / "a.fasta", ">x\nACGT\n"), write(tmp_path / "b.fastq", "@y\nGG\n+\n@@\n")
    with pytest.warns(UserWarning):
        assert rows(reads.read_files(spark, [a, b, a]), "read_id", "seq") == [("x", "ACGT"), ("y", "GG")]
    assert rows(reads.read_seeds(spark, write(tmp_path / "s.fasta", ">s 1\nACR\nT\n")), "read_id", "seq") == [("s 1", "ACRT")]
    with pytest.raises(ValueError):
        reads.read_seeds(spark, write(tmp_path / "t.fasta", ">s\nacg\n"))
    held = reads.from_memory(spark, ["AC", b"\xff"], [(b"GG", "TT")])
    assert rows(held, "read_id", "pair_id", "mate", "seq") == [("pair0", 0, 1, "GG"), ("pair0", 0, 2, "TT"), ("single0", None, None, "AC"), ("single1", None, None, "")]


def test_records(spark):
    contigs = spark.createDataFrame([(2, "GG", 1.5, False), (1, "AC", 2.0, True)], "number long, seq string, abundance double, circular boolean")
    assert [r[0] for r in sinks.contig_fasta(contigs).collect()] == [">Contig_1_2_Circ [topology=circular]\nAC", ">Contig_2_1.5\nGG"]
    assert [r[0] for r in sinks.plain_contig_fasta(contigs.drop("circular")).collect()] == [">Contig_1_0\nAC", ">Contig_2_0\nGG"]
    assert sinks.iteration_records(contigs, 21).first()[0] == ">kmer21_1 20 20\nAC" and sinks.connected_records(contigs).first()[0] == ">ConnectedRead_1\nAC"
    variants = [(3, r, 1.0 / 2**r, t, "A" * 150, "C" * 30, 150, "G") for r, t in ((1, "G"), (2, "TT"))]
    df = spark.createDataFrame(variants, "number long, rank int, score double, text string, before string, after string, start long, primary string")
    assert [r[0] for r in sinks.variant_records(df).collect()] == [f">Variant_1_for_Contig_3:51_181:0.25\n{'A' * 100}TT{'C' * 30}"]


def test_chunks_of_seeds(spark):
    from pyspark.sql import functions as F

    from strandline.functions import sequence as X
    from strandline.operators import chunks

    row = spark.createDataFrame([("ACRTN",)], "s string").select(chunks.seed_chunks(F.col("s")).alias("c")).select("c", chunks.expanded(F.col("c")).alias("all"), chunks.length_max(F.col("c")), chunks.primary(chunks.reversed_chunks(F.col("c")))).first()
    assert row["c"] == [["AC"], ["A", "G"], ["T"], ["A", "C", "G", "T"]] and row["all"] == ["AC" + r + "T" + n for r in "AG" for n in "ACGT"] and tuple(row)[2:] == (5, "TATGT")
    X.register(spark)
    got = spark.sql("select translate_codons('atgGCCnnnTA'), dna_entropy('ACGTACGTACGT'), dna_entropy('')").first()
    assert got[0] == "MAX" and got[1] > 0.99 and got[2] == 0 and X.codons_for("m") == ["ATG"]


def test_global_ranks_and_sums(spark):
    from pyspark.sql import functions as F

    from strandline.functions.ordering import cumulated, ranked_rows

    draw = random.Random(3)
    values = draw.sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    want, total = {}, 0
    for i, v in enumerate(sorted(values), 1):
        total += v
        want[v] = (i, total)
    assert {r["v"]: r["n"] for r in ranked_rows(df, "n", "v").collect()} == {v: i for v, (i, _) in want.items()}
    assert {r["v"]: r["s"] for r in cumulated(df, {"s": F.col("v")}, "v").collect()} == {v: t for v, (_, t) in want.items()}
    assert cumulated(df.limit(0), {"s": F.col("v")}, "v").count() == 0
