import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import decontamination, quality, simhash, substring_dedup
from strandline.llm.queries import ORACLE_SQL, QUERIES


def prose(draw, n):
    return " ".join(draw.choice("abcde") + draw.choice("aeiou") + draw.choice("xyzst") + draw.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(n=400, seed=1):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, good = prose(draw, draw.randint(20, 120)), draw.random() < 0.7
        if not good:
            text = draw.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: t.replace(" ", " | ")])(text)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if draw.random() < 0.7:
            labels.append((i, int(good), 0))
    return docs, labels


SCHEMA, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    docs += [(1000, None, None, None, 0), (1001, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, docs[3][1], "en", "s", 0)]
    rows = quality.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    truth, right = {i: q for i, q, _ in labels}, []
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in truth:
            right.append(r["predicted"] == truth[r["doc_id"]])
    assert len(right) > 30 and np.mean(right) > 0.95
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1000] == by_id[1001]


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    d = spark.createDataFrame(docs, SCHEMA)
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(d, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0)], [(None, 1, 0), (2, None, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], SCHEMA)
    assert quality.classify(docs, spark.createDataFrame(labels, LABELS)).count() == 2
    assert quality.classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_hinge_loss_comes_to_its_least():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 40, 6)).astype("i4") for _ in range(80)]
    good = np.array([len(r[r < 20]) > len(r[r >= 20]) for r in rows])
    model = quality.fit_rows(rows, good)
    assert np.mean([(model.margin(r) > 0) == g for r, g in zip(rows, good, strict=True)]) > 0.9


def test_long_words_count_whole():
    words = quality._Words()
    head = "ab1" * 30
    a, b = words[head + "..."], words[head + "!!!"]
    assert words.shape[a] != words.shape[b]


def test_stages_work_on_what_is_left(spark, tmp_path):
    docs, labels = corpus(200, 2)
    draw = random.Random(7)
    passage, item = prose(draw, 60), prose(draw, 30)
    near = prose(draw, 300).split()
    docs += [(300 + i, f"{prose(draw, 30)} {passage} {prose(draw, 30)}", "en", "s0", 0) for i in range(3)]
    docs += [(310, " ".join(near), "en", "s1", 0), (311, " ".join(near), "en", "s1", 0)]
    docs += [(320, f"{prose(draw, 30)} {item} {prose(draw, 30)}", "en", "s2", 0), (330, None, None, None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "mixing":
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        before, now = now, spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {r["doc_id"] for r in now.collect()}
        if name == "near_duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert kept[name] == set(groups.values()) and 310 in kept[name] and 311 not in kept[name]
        if name == "substrings":
            assert all(passage not in (r["text"] or "") for r in now.collect())
            cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removed_words(before).collect()}
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all((r["text"] == old[r["doc_id"]]) == (cut[r["doc_id"]] == 0) for r in now.collect())
        if name == "decontamination":
            leaks = {r["doc_id"] for r in decontamination.scan(before, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("contaminated").collect()}
            assert leaks == {320} and kept[name] == {r["doc_id"] for r in before.collect()} - leaks
    bad = {i for i, q, _ in labels if not q}
    assert len(kept["quality"] & bad) <= 2 and {300, 301, 302} <= kept["substrings"]
    assert kept["mixing"] == kept["decontamination"]
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in now.collect()}


def test_every_operator_has_its_query():
    import __spark_entry__

    assert [n for n in range(1, 11) if any(name.startswith(f"op{n}_") for name in QUERIES)] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert "pipeline" in __spark_entry__.queries()


def test_scores_keep_their_columns(spark):
    rows = [(1, "good text", "x", {"a": 1}), (1, None, None, None), (2, "word " * 300_000, "y", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, `a.b` map<string,int>")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int")
    model = quality.fit(df.select("doc_id", "text"), labels)
    got = quality.scores(df, model)
    assert got.columns == [*df.columns, "score"] and sorted(map(str, (tuple(r)[:4] for r in got.collect()))) == sorted(map(str, rows))
    assert all(0 <= r["score"] <= 1 for r in got.collect()) and quality.scores(df.limit(0), model).count() == 0


def test_the_dual_comes_to_the_primal():
    """The gap between the hinge loss and its dual closes, so the descent comes to the least loss."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 300, 40)).astype("i4") for _ in range(200)]
    good = np.array([int(g[:20].sum()) % 2 == 0 for g in rows])
    model = quality._descend(rows, good)
    weights = np.divide(model.weights, model.ratios, out=np.zeros_like(model.weights), where=model.ratios != 0).astype("f8")
    x = [(g, model.ratios[g] / np.linalg.norm(model.ratios[g])) for g in rows]
    sign = np.where(good, 1.0, -1.0)
    cost = quality.COST * np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    norm = float(weights @ weights + model.bias**2)
    loss = lambda w, b: 0.5 * float(w @ w + b * b) + float((cost * np.maximum(0, 1 - sign * np.array([w[g] @ v + b for g, v in x]))).sum())
    least = loss(weights, model.bias)
    for _ in range(50):  # no step away from it is better by much
        step, shift = draw.normal(size=weights.shape) * 0.01 * (weights != 0), draw.normal() * 0.01
        assert loss(weights + step, model.bias + shift) > least - 0.01 * (least + norm)
