import random

import pytest

from strandline.functions import tables
from strandline.operators import chunks, contig_graph


def linked(spark, links):
    return spark.createDataFrame(links, 'left long, right long')


def reach(links):
    out = {}
    for a in {x for link in links for x in link}:
        seen, front = set(), {a}
        while front:
            front = {r for f in front for l, r in links if l == f} - seen
            seen |= front
        out[a] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_equal_reach(spark, seed):
    draw = random.Random(seed)
    links = list({(draw.randrange(30), draw.randrange(30)) for _ in range(34)})
    to = reach(links)
    want = {a: min(b for b in to[a] if a in to[b]) for a in to if a in to[a]}
    assert {r["node"]: r["cycle"] for r in contig_graph.cycles(linked(spark, links)).collect()} == want and want


def test_no_links_and_no_cycles(spark):
    assert contig_graph.cycles(linked(spark, [])).count() == 0 == contig_graph.cycles(linked(spark, [(1, 2), (2, 3), (1, 3)])).count()
    assert contig_graph.bubbles(linked(spark, [])).count() == 0


def all_ways(links, most=5):
    out = []

    def on(start, way):
        out.append((start, way[-1], way))
        if len(way) < most:
            for l, r in links:
                if l == way[-1] and r != start and r not in way:
                    on(start, [*way, r])

    for l, r in links:
        if l != r:
            on(l, [r])
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_bubbles_and_what_collapse_leaves(spark, seed):
    draw = random.Random(seed)
    links = sorted({(draw.randrange(12), draw.randrange(12)) for _ in range(20)})
    length = {i: draw.choice([100, 200, 300]) for i in range(12)}
    pairs = {}
    for start, end, way in all_ways(links):
        pairs.setdefault((start, end), []).append(way)
    pairs = {p: sorted(ways, key=lambda w: (len(w), w)) for p, ways in pairs.items() if len(ways) > 1}
    df = linked(spark, links)
    assert {(r["start"], r["end"]): r["ways"] for r in contig_graph.bubbles(df).collect()} == pairs and pairs
    lost = set()
    for (start, _), ways in pairs.items():
        best = max(ways, key=lambda w: (sum(length[i] for i in w), len(w), w))
        for way in ways:
            if way != best:
                lost |= set(zip(way, way[1:]))
                lost |= {(start, way[0])} if way[0] != best[0] else set()
    got = contig_graph.collapsed(df, spark.createDataFrame(list(length.items()), "id long, length long"))
    assert {tuple(r) for r in got.collect()} == set(links) - lost


@pytest.mark.parametrize("seed", [5, 6])
def test_chains_equal_walks_in_the_order_of_ids(spark, seed):
    draw = random.Random(seed)
    rows = [(i, f"{'ACGT'[i % 4]}" * (5 + i % 3), draw.choice([None, *"abcdefgh"]), draw.choice([None, *"abcdefgh"])) for i in range(14)]
    rows += [(20, "AA", "r", "s"), (21, "ACGTA", "s", "r"), (22, "ACGTACG", None, "r"), (23, "TTTTTT", "q", "q")]
    first, taken, want = {}, set(), {}
    for i, _, left, _ in rows:
        if left is not None:
            first.setdefault(left, i)
    by_id = {r[0]: r for r in rows}
    for i in sorted(by_id):
        if i in taken:
            continue
        chain = [i]
        taken.add(i)
        while (j := first.get(by_id[chain[-1]][3])) is not None and j != chain[-1] and j not in taken:
            chain.append(j)
            taken.add(j)
        want[i] = (by_id[i][1] + "".join(by_id[j][1][4:] for j in chain[1:]), chain)
    got = contig_graph.chained(spark.createDataFrame(rows, "id long, seq string, left_end string, right_end string"), 4).collect()
    assert {r["id"]: (r["seq"], r["parts"]) for r in got} == want


def test_places_of_variations(spark):
    rows = [(1, [["ACG"], ["A", "CC"], ["GGTT"], ["T", "AA", "C"]]), (2, [["A"]]), (3, [["CC", ""], ["A"]])]
    got = chunks.placed(spark.createDataFrame(rows, "number long, chunks array<array<string>>")).orderBy("number", "i").collect()
    assert [tuple(r)[:6] for r in got] == [(1, 1, 3, "ACG", "A", "GGTT"), (1, 3, 8, "GGTT", "T", ""), (3, 0, 0, "", "CC", "A")]


def test_table_functions(spark):
    tables.register(spark)
    df = spark.sql("select s.i, k.* from (values (1, 'acgNACGTT'), (2, null), (3, 'AC')) s(i, seq), lateral kmers_of(s.seq, 3) k")
    assert [tuple(r) for r in df.orderBy("i", "pos").collect()] == [(1, 0, "ACG", True), (1, 4, "ACG", True), (1, 5, "ACG", False), (1, 6, "AAC", False)]
    df = spark.sql("select f.* from frames_of('ATGAAN') f")
    assert {r["frame"]: r["protein"] for r in df.collect()} == {1: "MX", 2: "*", 3: "E", -1: "XH", -2: "F", -3: "S"}


def test_tables_on_the_way_are_removed(spark):
    from strandline.functions import staging

    def made():
        seen.append(staging.staged(spark.range(5), "inner"))
        return seen[0].selectExpr("id + 1 as id")

    seen = []
    table = staging.staged_alone(spark, made, "outer")
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception):
        seen[0].collect()
    staging.drop(table)
    with pytest.raises(Exception):
        table.collect()
