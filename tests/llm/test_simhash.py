import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from strandline.llm import simhash
from strandline.llm.components import smallest_reachable


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def corpus():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(4))
    out = [None, "", "  \n", "One", "one", "two words", "ÀB c d e"]
    for _ in range(8):
        base = [word() for _ in range(120)]
        out += [" ".join(base)] * 2
        for _ in range(4):
            near = list(base)
            near[draw.randrange(120)] = word()
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("compared", [2048, 2])
def test_groups_equal_brute_force(spark, compared):
    texts = corpus()
    rows = list(enumerate(texts)) + [(5, texts[5])]
    fps = {i: fingerprint(t) for i, t in rows}
    root = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in simhash.near_duplicates(df, compared=compared).collect()]
    assert sorted(got) == sorted((i, f"{fps[i]:016x}", root[i]) for i, _ in rows)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(root.values()))


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (4, "x y z w")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, None), (3, None), (4, 4)}
    assert [r["doc_id"] for r in simhash.keep_one(df).orderBy("doc_id").collect()] == [None, 4]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_own_ids_link_nothing(spark):
    draw = random.Random(11)
    unlike = [" ".join(str(draw.randrange(10**6)) for _ in range(40)) for _ in range(8)]
    # three unlike texts without id, two that share an id, and a copy of one of each
    rows = [(None, unlike[0], 0), (None, unlike[1], 0), (None, unlike[2], 0), (7, unlike[3], 0), (7, unlike[4], 0), (8, unlike[0], 1), (9, unlike[4], 1), (10, unlike[5], 0), (10, unlike[5], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long").repartition(3)
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    want = [(None, unlike[0], 0), (None, unlike[1], 0), (None, unlike[2], 0), (7, unlike[3], 0), (7, unlike[4], 0), (10, unlike[5], 0)]
    assert sorted(kept, key=str) == sorted(want, key=str)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    hexes = [f"{fingerprint(t):016x}" for t in unlike]
    assert got == {(None, hexes[0], None), (None, hexes[1], None), (None, hexes[2], None), (7, hexes[3], 7), (7, hexes[4], 7), (8, hexes[0], None), (9, hexes[4], 7), (10, hexes[5], 10)}


@pytest.mark.parametrize("compared", [2, 5, 1000])
@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_groups_across_batches(compared, cut):
    draw = np.random.default_rng(compared)
    df = pd.DataFrame({"variant": np.sort(draw.integers(0, 25, 300)), "fp": draw.integers(0, 1 << 7, 300)})
    df = df.drop_duplicates().reset_index(drop=True)
    batches = [df.iloc[i : i + cut] for i in range(0, len(df), cut)]
    out = pd.concat(simhash._verified(compared)(iter(batches)))
    dense = set(out[out["v"].isna()]["u"])
    links = set(out[out["v"].notna()][["u", "v"]].itertuples(index=False, name=None))
    for _, group in df.groupby("variant"):
        nodes = list(group["fp"])
        if len(nodes) > compared:
            assert set(nodes) <= dense
            continue
        want = components(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
        got = components(nodes, lambda a, b: (a, b) in links or (b, a) in links)
        assert all(got[a] == got[b] for a in nodes for b in nodes if want[a] == want[b])


def test_all_near_pairs_meet():
    """Every pair within three bits shares a variant, wherever its bits lie."""
    draw = np.random.default_rng(5)
    for _ in range(200):
        a = draw.integers(0, 1 << 64, dtype="u8")
        b = a ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, 3, dtype="u8"))
        rows = pd.concat(simhash._block_balls(iter([pd.DataFrame({"fp": np.array([a, b]).view("i8")})])))
        assert len(rows) == 262 and (rows.groupby("variant")["fp"].nunique() == 2).any()


def test_a_hub_of_very_many_edges(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(5000 + i, i) for i in range(2, 500)]
    got = {tuple(r) for r in smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 1) for _, i in edges} | {(i, 1) for i, _ in edges if i > 1}


def test_kept_rows_keep_their_columns(spark):
    rows = [(1, "a b c d", "x", 1, {"k": 1}), (2, "a b c d", "y", 2, {}), (3, " ".join(map(str, range(50_000))), None, 3, None), (None, None, "z", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, fp int, `a.b` map<string,int>")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150), (150, 200)]
    random.Random(0).shuffle(edges)
    got = {tuple(r) for r in smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 1) for i in range(2, 61)} | {(101, 100), (102, 100), (200, 150)}
