import random

import duckdb
import pytest

from strandline import catalog
from strandline.functions import sequence as X
from strandline.functions.packing import Packing as Packing_of
from strandline.operators import contigs, graph, kmers, mapping, stats
from strandline.plans.assembly import Assembler, Parameters, longest_k, next_ks
from strandline.sources import sinks

SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(SWAP)


def frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")


def genome(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("ACGT") for _ in range(n))


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTN", "atgGCCnnnTA")], "a string, b string")
    row = df.select(X.revcomp("a"), X.translate_codons(df.b), X.iupac_match(X.F.lit("R"), X.F.lit("A")), X.iupac_match(X.F.lit("D"), X.F.lit("W")), X.collapse_iupac(X.F.lit("AG")), X.expand_iupac(X.F.lit("b"))).first()
    assert tuple(row) == ("NACGT", "MAX", True, False, "R", "CGT")
    values = [r[0] for r in spark.createDataFrame([("AAAAAAAAAA",), ("ACGTACGTACGT",), ("",)], "s string").select(X.entropy(X.F.col("s"))).collect()]
    assert values[0] < 0.1 and values[1] > 0.99 and values[2] == 0
    X.register(spark)
    assert spark.sql("select revcomp('AAC'), canonical_kmer('GTT')").first() == ("GTT", "AAC")


def test_masks_equal_brute_force(spark):
    reads = frame(spark, [genome(3, 400)[i : i + 60] for i in range(0, 340, 7)])
    counts = kmers.count_kmers(reads, 5)
    nodes = {r["kmer"] for r in kmers.lettered(counts, 5).collect()}
    canon = lambda w: min(w, rc(w), key=lambda x: x.translate(str.maketrans("ACTG", "0123")))
    want = {}
    for node in nodes:
        want[node] = sum(1 << (n + 4 * m) for m, w in enumerate((node, rc(node))) for n, b in enumerate("ACTG") if canon(w[1:] + b) in nodes and canon(w[1:] + b) != node)
    assert {r["kmer"]: r["branch"] for r in kmers.lettered(graph.branches(counts, 5), 5).collect()} == want


def test_contigs_of_a_plain_genome(spark):
    g, k = genome(5, 900), 21
    reads = frame(spark, [g[i : i + 100] for i in range(0, 801, 2)])
    counts = kmers.count_kmers(reads, k, 2)
    found = [r["seq"] for r in contigs.unitigs(counts, k).collect()]
    assert len(found) == 1 and (found[0] in g or rc(found[0]) in g) and len(found[0]) > 880
    made = Assembler(Parameters(min_count=2)).assemble(reads)
    seq = made.contigs.first()["seq"]
    assert made.contigs.count() == 1 and (seq in g or rc(seq) in g)
    report = made.report.first()
    assert report["n50"] == report["total"] == len(seq) and report["l50"] == 1
    assert made.unused.count() < reads.count()
    assert sinks.contig_fasta(made.contigs).first()[0].startswith(">Contig_1_")


def test_reversed_reads_give_the_same_graph(spark):
    seqs = [genome(7, 300)[i : i + 50] for i in range(0, 250, 5)]
    a, b = (kmers.count_kmers(frame(spark, s), 15) for s in (seqs, [rc(s) for s in seqs]))
    assert {(r["kmer"], r["cnt"], r["plus"]) for r in a.collect()} == {(r["kmer"], r["cnt"], r["cnt"] - r["plus"]) for r in b.collect()}


def test_rings_are_opened(spark):
    g, k = genome(11, 200), 21
    ring = g + g[: k - 1]
    counts = kmers.count_kmers(frame(spark, [ring] * 3), k)
    found = [r["seq"] for r in contigs.unitigs(counts, k).collect()]
    assert sum(len(s) - k + 1 for s in found) in (200, 400)  # one direction, or both where the smallest nodes differ
    rows = contigs.rotated(contigs.trimmed(contigs.unitigs(counts, k), k), k).collect()
    assert [(len(r["seq"]), r["circular"]) for r in rows] == [(200, True)] and (rows[0]["seq"] in g * 2 or rc(rows[0]["seq"]) in g * 2)
    for s in found:
        assert s in g * 3 or rc(s) in g * 3


def test_placement_and_runs(spark):
    g, k = genome(13, 400), 21
    contig = spark.createDataFrame([(1, g)], "id long, seq string")
    reads = frame(spark, [g[50:150], rc(g[200:300]), genome(99, 100)])
    got = {r["read_id"]: (r["strand"], r["position"]) for r in mapping.place(reads, contig, k).collect()}
    assert got == {0: (1, 50), 1: (-1, 299)}
    assert {r["read_id"] for r in mapping.unused_reads(reads, contig, k, 60).collect()} == {0, 2}
    counts = kmers.count_kmers(frame(spark, [g[100:130], g[100:130]]), k)
    run = mapping.longest_covered_run(reads, counts, k, 2).collect()
    assert [(r["read_id"], r["start"], r["length"]) for r in run] == [(0, 50, 30)]


def test_overlaps_and_gfa(spark):
    g = genome(17, 300)
    df = spark.createDataFrame([(1, g[:150]), (2, g[120:]), (3, rc(g[100:180]))], "id long, seq string")
    links = contigs.overlaps(df)
    assert {tuple(r) for r in links.collect()} == {(1, 2, "+", 30), (1, 3, "-", 50)}
    assert [r[0].split("\t")[0] for r in sinks.gfa(df, links).collect()] == ["H", "S", "S", "S", "L", "L"]


@pytest.mark.parametrize("lengths", [[5], [1, 2, 3, 4], [7, 7, 7], [10, 1, 1, 1], [3, 0, 2]])
def test_statistics(spark, lengths):
    df = spark.createDataFrame([(n,) for n in lengths], "length long")
    down, total = sorted((n for n in lengths if n), reverse=True), sum(lengths)
    want, cum = {}, 0
    for i, n in enumerate(down, 1):
        cum += n
        for name, part in (("50", 0.5), ("90", 0.9)):
            if cum >= int(total * part):
                want.setdefault(f"n{name}", n)
                want.setdefault(f"l{name}", i)
    got = stats.report(df).first().asDict()
    assert {k: got[k] for k in want} == want and got["longest"] == down[0]


def test_parameters_are_checked():
    for bad in ({"k": 20}, {"k": 22}, {"fraction": 1.0}):
        with pytest.raises(ValueError):
            Parameters(**bad)
    assert next_ks(21, 61, 5) == [31, 41, 51, 61] and next_ks(21, 25, 5) == []
    assert next_ks(21, 50, 4) == [31, 39, 49] and next_ks(21, 35, 11) == [23, 25, 27, 29, 31, 33, 35]
    assert longest_k(21, 100, 5.0, 10) == 21 and longest_k(21, 100, 40.0, 10) == 81


def test_longer_k_resolve_a_repeat(spark):
    a, b, c, repeat = genome(21, 400), genome(22, 400), genome(23, 400), genome(24, 35)
    g = a + repeat + b + repeat + c
    reads = frame(spark, [w if i % 2 else rc(w) for i, w in enumerate(g[i : i + 100] for i in range(0, len(g) - 99, 3))])
    one = [r["seq"] for r in Assembler(Parameters(min_count=2, min_contig=100)).assemble(reads).contigs.collect()]
    assert len(one) == 3 and all(s in g or rc(s) in g for s in one)
    made = Assembler(Parameters(min_count=2, min_contig=100, steps=3, max_k=61)).assemble(reads)
    seqs = [r["seq"] for r in made.contigs.collect()]
    assert len(seqs) == 1 and (seqs[0] in g or rc(seqs[0]) in g) and len(seqs[0]) > len(g) - 2 * (61 + 20)
    assert list(made.iterations) == [21, 41, 61] and [d.count() for d in made.iterations.values()] == [3, 1, 1]
    assert sinks.iteration_records(made.iterations[61], 61).first()[0].startswith(">kmer61_1 60 60\n")


def test_contigs_join_the_next_graph(spark):
    k, s, ring = 5, genome(31, 40), genome(32, 30)
    first = kmers.count_kmers(frame(spark, [s] * 4), 3)
    old = spark.createDataFrame([(s, False), (ring, True)], "seq string, circular boolean")
    reads = kmers.count_kmers(frame(spark, [s[:10]] * 9 + ["ACACACACAC"]), k)
    got = {r["kmer"]: (r["cnt"], r["plus"]) for r in kmers.lettered(contigs.recycled(reads, old, first, 3, k, 2), k).collect()}
    canon = lambda w: min(w, rc(w), key=lambda x: x.translate(str.maketrans("ACTG", "0123")))
    tri = [canon(s[i : i + 3]) for i in range(38)]
    closed = ring + ring[:2]
    n = {canon(s[i : i + 3]): 4 * tri.count(canon(s[i : i + 3])) for i in range(38)}
    abundance = [sum(n.get(canon(x[i : i + 3]), 0) for i in range(len(x) - 2)) / (len(x) - 2) for x in (s, closed)]
    want = {r["kmer"]: (r["cnt"], r["plus"]) for r in kmers.lettered(reads, k).collect()}
    for x, mean in zip((s, ring + ring[: k - 1]), abundance, strict=True):
        cnt = max(int(mean + 0.5), 2)
        for i in range(len(x) - k + 1):
            w = canon(x[i : i + k])
            want[w] = max(want.get(w, (0, 0)), (cnt, cnt // 2))
    assert got == want
    kept = contigs.carried(spark.createDataFrame([(s[5:], False)], old.schema), old, k)
    assert {tuple(r) for r in kept.collect()} == {(s[5:], False), (ring, True)}
    empty = old.limit(0)
    assert contigs.carried(empty, old, k).count() == 2 and contigs.recycled(reads, empty, first, 3, k, 2).count() == reads.count()


def test_reads_in_a_ring_are_used(spark):
    g = genome(41, 300)
    reads = frame(spark, [g[:60], g[100:160], (g + g)[280:340], genome(42, 60)])
    for ring, want in ((True, {3}), (False, {0, 2, 3})):
        found = spark.createDataFrame([(0, g, ring)], "id long, seq string, circular boolean")
        assert {r["read_id"] for r in mapping.unused_reads(reads, found, 21, 50).collect()} == want


def test_queries_have_names_and_sql():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["kmer_hist", "branch_bits", "strand_balance", "longest_good_run", "six_frame", "clean_reads", "graph_histograms", "node_states", "seed_survival", "variant_scores", "kmers_outside"])
def test_queries_equal_sql(spark, tmp_path, name):
    draw = random.Random(4)
    text = ["".join(draw.choice("abcdefgh ,.Z") for _ in range(300)) for _ in range(6)]
    con = duckdb.connect()
    tables = {
        "documents": "select i as doc_id, t as text, length(t) as n_chars from x",
        "benchmark": "select i as item_id, t as text from x",
        "pages": "select i as page_id, t as html from x",
    }
    con.execute("create table x as select unnest(range(8)) as i, unnest($1) as t", [[*text, text[0], text[1][:200]]])
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stream_equals_batch(spark, tmp_path):
    from strandline.streaming import histogram_so_far, partial_counts

    seqs = [genome(i, 80) for i in range(6)] * 2
    for part in range(3):
        frame(spark, seqs[part * 4 : part * 4 + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = partial_counts(stream, 11, str(tmp_path / "parts"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in kmers.histogram(kmers.count_kmers(frame(spark, seqs), 11)).collect()}
    assert {tuple(r) for r in histogram_so_far(spark, str(tmp_path / "parts")).collect()} == want


@pytest.mark.parametrize("k", [4, 5, 21, 30, 31, 32, 45])
def test_packed_kmers_do_as_their_letters(spark, k):
    from strandline.functions.packing import Packing

    draw, p, order = random.Random(k), Packing(k), str.maketrans("ACTG", "0123")
    words = ["".join(draw.choice("ACGT") for _ in range(k)) for _ in range(50)] + [b * k for b in "ACGT"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("x", p.parse(X.F.col("w")))
    x, nt = X.F.col("x"), X.F.lit(2)
    rows = df.select("w", *(p.text(e).alias(n) for n, e in (("t", x), ("r", p.revcomp(x)), ("c", p.canonical(x)), ("s", p.step(x, nt)), ("j", p.join(nt, p.suffix(x))), ("e", p.extend(p.prefix(x), nt)))), p.first(x).alias("f"), p.last(x).alias("l"), p.tail(x, "GG").alias("g")).collect()
    for r in rows:
        w = r["w"]
        assert (r["t"], r["r"], r["c"]) == (w, rc(w), min(w, rc(w), key=lambda s: s.translate(order)))
        assert (r["s"], r["j"], r["e"]) == (w[1:] + "T", "T" + w[1:], w[:-1] + "T")
        assert (r["f"], r["l"], r["g"]) == ("ACTG".index(w[0]), "ACTG".index(w[-1]), w.endswith("GG"))
    assert [r["w"] for r in df.orderBy("x").collect()] == sorted(words, key=lambda s: s.translate(order))


def test_dead_ends_are_trimmed(spark):
    """A branch of a few bases beside a well covered way is dropped, a long one isn't."""
    g, k = genome(47, 400), 21
    x, y = sorted(set("ACGT") - {g[200]})[:2]
    short, long = g[150:200] + x + genome(48, 30), g[150:200] + y + genome(49, 150)
    both = lambda s: [s, rc(s)]
    counts = kmers.count_kmers(frame(spark, both(g) * 10 + both(short) * 4 + both(long) * 4), k)
    counts = counts.cache()
    at = X.F.col("src") == Packing_of(k).parse(X.F.lit(g[179:200]))
    whole = graph.successors(graph.by_abundance(graph.forks_of(counts, k, 2), 0.1, 2), k).where(at).count()
    left = [r["dst"] for r in kmers.lettered(graph.successors(graph.fully_filtered(counts, k), k).where(at), k, "dst").collect()]
    assert whole == 3 and sorted(left) == sorted([g[180:201], long[30:51]])


@pytest.mark.parametrize("name", ["fork_extendable", "fork_full_filter"])
def test_ways_out_equal_sql(spark, tmp_path, name):
    """The recursive SQL on a text in which lines come back, with branches that end early."""
    draw = random.Random(8)
    line = "".join(draw.choice("abcdefghijklmnop") for _ in range(260))
    texts = [line] * 8 + [line[:100] + "".join(draw.choice("abcd") for _ in range(n)) for n in (10, 60, 120) for _ in range(2)] + [line[40:140] * 2] * 2
    con = duckdb.connect()
    con.execute("create table documents as select unnest(range(len($1))) as doc_id, unnest($1) as text", [texts])
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want) and (name != "fork_extendable" or {r[2] for r in rows} == {True, False})


def test_a_changed_base_is_a_bubble(spark):
    g, k = genome(23, 300), 21
    other = g[:150] + ("A" if g[150] != "A" else "C") + g[151:]
    counts = kmers.count_kmers(frame(spark, [s for x in (g, other) for s in (x, rc(x))] * 3), k)
    rows = contigs.bubbles(counts, k, 2 * k).collect()
    assert len(rows) == 1
    want = {g[150], other[150]}
    assert set(rows[0]["variants"]) in (want, {rc(b) for b in want})
    assert rows[0]["src"] in (g[129:150], rc(g[151:172]))
    assert contigs.bubbles(kmers.count_kmers(frame(spark, [g, g]), k), k, 2 * k).count() == 0


def test_reach_equals_brute_force(spark):
    links = {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("e", "f")}
    df = spark.createDataFrame(sorted(links), "src string, dst string")
    got = {tuple(r) for r in graph.reachable(graph.forking(df), df, 3).select("start", "node", "depth").collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "a", 3)}


def test_pairs_by_their_place(spark):
    g = genome(29, 600)
    contig = spark.createDataFrame([(1, g)], "id long, seq string")
    mates = [
        (0, g[100:160], rc(g[200:260])),  # deep on its own
        (1, g[10:60], rc(g[520:590])),  # faces its mate inside
        (2, g[540:590], genome(31, 50)),  # one mate elsewhere
        (3, g[100:110], rc(g[200:260])),  # too short
    ]
    rows = [(i, m, s) for i, a, b in mates for m, s in ((1, a), (2, b))] + [(4, 1, g[100:160])]
    pairs = spark.createDataFrame(rows, "pair_id long, mate int, seq string")
    got = {r["pair_id"]: (r["fate"], r["seq"]) for r in mapping.classify_pairs(pairs, contig, 21, 50, 100).collect()}
    assert got == {0: ("deep", None), 1: ("internal", g[10:590]), 2: ("kept", None), 3: ("kept", None)}


def test_variants_share_the_counts(spark):
    g, k = genome(37, 120), 21
    other = g[:60] + ("A" if g[60] != "A" else "C") + g[61:]
    counts = kmers.count_kmers(frame(spark, [g] * 3 + [other]), k)
    places = [(1, g[:60], b, g[61:]) for b in (g[60], other[60])] + [(2, "", g, ""), (3, "A" * 30, "C", "C" * 30), (3, "A" * 30, "G", "C" * 30)]
    rows = contigs.variant_scores(spark.createDataFrame(places, "id long, before string, text string, after string"), counts, k).collect()
    assert {(r["id"], r["text"]): (r["score"], r["rank"]) for r in rows} == {(1, g[60]): (0.75, 1), (1, other[60]): (0.25, 2), (2, g): (1.0, 1), (3, "G"): (0.0, 1), (3, "C"): (0.0, 2)}


def test_contigs_in_the_graph(spark):
    g, k = genome(41, 100), 21
    counts = kmers.count_kmers(frame(spark, [g, g]), k)
    parts = spark.createDataFrame([(g[:40],), (g[15:60],), (genome(43, 50),), ("ACGT",)], "seq string")
    states = {r["state"]: r["n"] for r in contigs.node_states(counts, parts, k).groupBy("state").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert states == {3: 5, 1: 35, 0: 40} and contigs.kmers_outside(counts, parts, k).count() == 40
    assert {r["seq"] for r in contigs.surviving_seeds(parts, counts, k, 2).collect()} == {g[:40], g[15:60], "ACGT"}
