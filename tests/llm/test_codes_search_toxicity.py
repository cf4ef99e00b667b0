import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from strandline.llm import ranked_search, toxicity, vector_codes

# Vector codes.


def coded(rows, rounds=4):
    """vec_id, code, error, label_error of each vector, and the digest of the codebooks, one part after another."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    grid = [[math.floor(1024 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:256]
    codes, errors, flat = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        part = [tuple(g[p * width // 4 : (p + 1) * width // 4]) for g in grid]
        book = [part[i] for i in first]
        for step in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book)) for x in part]
            if step < rounds:
                for n in range(len(book)):
                    own = [x for x, (_, m) in zip(part, near, strict=True) if m == n]
                    if own:
                        book[n] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
        codes = [c + f"{n:02x}" for c, (_, n) in zip(codes, near, strict=True)]
        errors = [e + d for e, (d, _) in zip(errors, near, strict=True)]
        flat += [c for e in book for c in e]
    total = collections.Counter()
    for (_, _, x), e in zip(kept, errors, strict=True):
        total[x] += e
    top = (1 << 63) - 1
    return [(i, c, min(e, top), min(total[x], top)) for (i, _, x), c, e in zip(kept, codes, errors, strict=True)], hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, keys string, n long"


def test_codes_equal_brute_force(spark):
    draw = random.Random(4)
    rows = [(i, [float(np.float32(draw.gauss(0, 0.3))) for _ in range(12)], draw.choice([0, 1, 2, None])) for i in range(500)]
    rows += [(i, rows[7][1], 1) for i in range(500, 900)]  # a group of copies
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * 10, 1), (902, [float("nan")] * 12, 2), (903, [float("inf")] + [0.0] * 11, None), (904, [-0.0] * 12, 3)]
    rows += [(3, rows[9][1], 0), (None, rows[9][1], 0), (None, [0.5] * 12, None), (905, [0.25] * 9, 3), (906, [], 3)]
    want, digest = coded(rows)
    df = spark.createDataFrame([(*r, "key", 1) for r in rows], VECTORS).repartition(5)
    got = vector_codes.encode(df).collect()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sorted(map(str, want)) == sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got)


def test_few_odd_and_huge_vectors(spark):
    for rows in ([], [(1, None, 0)], [(5, [], None)], [(1, [0.5], 0), (2, [-0.5, 3.0], 0)], [(1, [3e38, -3e38, 0.0, 1.0], 0), (2, [1e30] * 4, None), (3, [2.0**40] * 5, 0)]):
        got = vector_codes.encode(spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS)).collect()
        if any(abs(c) > 1e20 for _, v, _ in rows for c in v or []):  # held at MOST
            rows = [(i, [max(min(c, 2.0**52), -(2.0**52)) for c in v], x) for i, v, x in rows]
        want, digest = coded(rows)
        assert sorted(map(str, want)) == sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got)
        assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_parts_go_in_as_few_bytes_as_hold_them():
    for part, size in (([0, -3], 4), ([1 << 15, 0], 8), ([1 << 31, 0], 16), ([-(1 << 15), 1], 8)):
        data = vector_codes.pack(np.array(part))
        assert len(data) == size and vector_codes.unpack([data], 2).tolist() == [part]


# Ranked search.

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, collections.Counter(TERM.findall((t or "").translate(low)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(TERM.findall((text or "").translate(low))), []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize(("held", "most_bytes"), [(8_000_000, 1 << 20), (400, 60)])
def test_ranks_equal_brute_force(spark, monkeypatch, held, most_bytes):
    monkeypatch.setattr(ranked_search, "HELD", held)
    monkeypatch.setattr(ranked_search, "STEP", 2)
    draw = random.Random(6)
    words = [f"{draw.choice('abé')}{i}" for i in range(60)]
    prose = lambda n: draw.choice([" ", "\n", "@", "{"]).join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, prose(draw.choice([1, 3, 30, 200])).upper()) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 400)] + [(5, docs[5][1]), (None, docs[6][1]), (None, prose(9)), (401, None), (402, ""), (403, " .,@[`{\x7f")]
    docs += [(404, " ".join(words) * 500)]
    items = [(i, prose(n)) for i, n in enumerate([0, 1, 2, 5, 40, 400])] + [(3, docs[5][1]), (None, "a0 a1 é2"), (8, None), (9, "unheard of"), (10, docs[5][1])]
    got = ranked_search.search_all(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item long").repartition(6), spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes)
    assert sorted(map(str, (tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()))) == sorted(map(str, ranked(docs, items)))


def test_search_over_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert ranked_search.search_all(docs.limit(0), items).count() == 0
    assert ranked_search.search_all(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked_search.search_all(docs, items).collect()] == [("x", 1, 1, 1000 * 0 + math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]


def test_the_threshold_stops_early(monkeypatch):
    """With one document far ahead in every list, documents deep in the lists are never looked up."""
    n = 4000
    impact = np.array([[1000] * 3] + [[3] * 3] * (n - 1))
    document, term = (x.ravel() for x in np.indices((n, 3)))
    block = ranked_search.Block(np.arange(n), document, term, impact.ravel(), 3)
    looked = []
    forward = block.forward
    block.forward = type("Counted", (), {"__getitem__": lambda self, at: looked.append(len(at[0])) or forward[at]})()
    none = np.empty(0, dtype="i8")
    scores, ids = ranked_search.search(block, np.arange(3), np.ones(3, dtype="i8"), (none, none), 1)
    assert (scores.tolist(), ids.tolist()) == ([3000], [0]) and sum(looked) < 100
    scores, ids = ranked_search.search(block, np.arange(3), np.ones(3, dtype="i8"), (none, none), 2)  # ties aren't cut off
    assert (scores.tolist(), ids.tolist()) == ([3000, 9], [0, 1])


# Toxicity.

DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def corpus(n=900):
    draw = random.Random(8)
    insults = {"en": ["idiot", "moron", "scum"], "de": ["achlich" + e for e in "abcdefgh"], "fr": []}
    docs, labels = [], []
    for i in range(n):
        lang, bad = draw.choice(["en", "en", "de"]), draw.random() < 0.15
        words = ["".join(draw.choices(["an", "er", "the", "in", "ou"], k=3)) for _ in range(draw.randint(5, 150))]
        for _ in range(draw.randint(3, 6) if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(insults[lang]) + draw.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), lang, 0.5))
        if draw.random() < 0.9:
            labels.append((i, 1, int(bad)))
    return docs, labels


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_toxicity(spark):
    docs, labels = corpus()
    long = " ".join(["the"] * 45_000 + ["idiot", "scum", "moron"] + ["the"] * 30)
    docs += [(2000, None, None, 0.0), (2001, "", "en", 0.0), (None, docs[3][1], "de", 0.0), (3, docs[3][1], "en", 0.0), (2002, long, "en", 0.0), (2003, " ".join(["the"] * 45_000), "xx", 0.0)]
    rows = toxicity.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    truth, right = {i: t for i, _, t in labels}, []
    for r in rows:
        assert r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in truth:
            right.append((truth[r["doc_id"]], r["predicted"], r["flagged"]))
    bad = [x for x in right if x[0]]
    assert len(bad) > 15 and np.mean([p for _, p, _ in bad]) > 0.9 and np.mean([f for _, _, f in bad]) > 0.9
    assert np.mean([p for t, p, _ in right if not t]) < 0.03
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2000]["score"] == by_id[2001]["score"] < 0.3
    assert by_id[2002]["predicted"] == 1 and by_id[2003]["predicted"] == 0


def test_held_out_toxicity_is_never_used(spark):
    docs, labels = corpus(300)
    turned = [(i, q, 1 - t if is_held_out(i) else t) for i, q, t in labels] + [(None, 1, 1), (5, 1, None)]
    d = spark.createDataFrame(docs, DOCS)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.classify(d, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b
    c = {r["doc_id"]: r["score"] for r in toxicity.classify(spark.createDataFrame([(i, t, None, s) for i, t, _, s in docs], DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert a == c  # the language decides no score


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 1)], [(None, 1, 0), (2, None, None)]])
def test_few_toxic_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a", "en", 0.1), (2, "", None, 0.1)], DOCS)
    rows = toxicity.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == 2 and len({r["score"] for r in rows}) == 1
    assert toxicity.classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_strides_give_what_the_whole_text_gives(monkeypatch):
    draw = np.random.default_rng(3)
    model = toxicity._new()
    words = draw.integers(0, toxicity.BUCKETS, (40, toxicity.PIECES))
    rows, numbers = model.projected(words), draw.integers(0, 40, 500).astype("i4")
    whole = model.margin(numbers, rows)
    for stride in (1, 2, 7, 499, 500):
        monkeypatch.setattr(toxicity, "STRIDE", stride)
        assert model.margin(numbers, rows) == pytest.approx(whole, rel=1e-5)


def test_gradients_are_those_of_the_loss():
    """One step's change of the loss is what the gradients say, for a text with a window over its end."""
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 30, n).astype("i4") for n in (1, 2, 40, 0, 9)]
    words, bad = draw.integers(0, 500, (30, toxicity.PIECES)), np.array([True, False, True, False, True])
    before = toxicity._train(texts, words, bad, np.ones(5), 0)
    after = toxicity._train(texts, words, bad, np.ones(5), 30)

    def loss(model):
        rows = model.projected(words)
        margins = np.array([model.margin(t, rows) for t in texts])
        return float(np.logaddexp(0, np.where(bad, -margins, margins)).mean())

    assert loss(after) < 0.7 * loss(before)


def test_thresholds_lie_between_the_classes():
    assert toxicity.threshold_of(np.array([0.9, 0.8, 0.4, 0.1]), np.array([True, True, False, False]), np.ones(4)) == pytest.approx(0.6)


def test_all_labels_are_fitted_to(spark, monkeypatch):
    """In several parts, and with more rows of a class than any one of them holds."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    ids = [i for i in range(5700) if not is_held_out(i)]
    bad = {i for i in ids if i % 7}
    order = [r["i"] for r in spark.createDataFrame([(i,) for i in sorted(bad)], "i long").selectExpr("i", "xxhash64(i) AS h").orderBy("h", "i").collect()]
    late = set(order[3000:])  # words of rows that were once left out
    docs = [(i, f"the {'zebra' if i in late else 'idiot' if i in bad else 'house'} in a{i}", "en", 0.0) for i in ids] + [(9001, "the zebra in b", "en", 0.0), (9002, "the house in b", "en", 0.0)]
    d, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, 1, int(i in bad)) for i in ids], LABELS)
    parts, n_good, n_bad = toxicity._labelled(d, labels, "text", "doc_id", "toxic", "lang")
    packed = list(toxicity._Part.unpacked([parts.toPandas()]))
    assert len(late) > 100 and (n_good, n_bad) == (len(ids) - len(bad), len(bad))
    assert len(packed) > 3 and sum(len(p.texts) for p in packed) == len(ids) and sum(p.bad.sum() for p in packed) == len(bad)
    start = toxicity._started(parts)
    assert toxicity._margins(parts, [s.model() for s in start[: toxicity.FOLDS]]).agg({"n": "sum"}).first()[0] == len(ids)
    rows = {r["doc_id"]: r for r in toxicity.classify(d, labels).collect()}
    assert rows[9001]["score"] > 0.9 and rows[9001]["flagged"] and rows[9002]["score"] < 0.3 and not rows[9002]["flagged"]
