import collections
import hashlib
import random
import time
import re

import numpy as np
import pytest

from strandline.llm import decontamination, html_text, licenses, mixing, sketches, substring_dedup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def prose(draw, n, letters="abcdeé"):
    return [draw.choice(letters) + draw.choice(letters) + draw.choice("xyz") for _ in range(n)]


# Substrings.


def test_every_shift_has_an_anchor():
    assert {int(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(21))


def test_equal_windows_have_equal_hashes():
    draw = np.random.default_rng(0)
    words = draw.integers(0, 2**63, 400).astype("u8")
    words[300:340] = words[17:57]
    for base in (0, 1):
        h = substring_dedup.window_hashes(words, 35, base)
        assert len(h) == 366 and (h[300:306] == h[17:23]).all() and len(np.unique(h)) == 360
    assert len(substring_dedup.window_hashes(words[:10], 35)) == 0


def cut(texts, window):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def colliding(spark, n=250_000):
    """Two unlike texts of 61 and 40 words with the same 32-bit hash."""
    texts = spark.range(n).selectExpr("concat_ws(' ', transform(sequence(1, if(id % 2 = 0, 61, 40)), i -> concat('t', id, 'w', i))) as t", "id % 2 as kind")
    pairs = texts.groupBy(mixing.F.hash("t").alias("h")).agg(mixing.F.collect_list(mixing.F.struct("kind", "t")).alias("x")).where("size(x) > 1 and array_min(x).kind != array_max(x).kind")
    return [x["t"] for x in sorted(pairs.first()["x"])]


def test_texts_of_one_id_never_share_places(spark):
    long, short = colliding(spark)
    other = short + " " + " ".join(f"q{i}" for i in range(50))
    texts = [long, short, other, None, "", "a b"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_words(df).collect())
    assert got == sorted(cut(texts, 35))
    left = {r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    assert left == {long, "", " ".join(f"q{i}" for i in range(50)), None, "a b"}


def test_very_many_null_ids_and_copies(spark):
    draw = random.Random(3)
    passage = " ".join(prose(draw, 40))
    texts = [f"n{i} " + (passage if i % 1000 == 0 else "x y z") for i in range(60_000)] + [passage + " end"] * 40_000
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(8)
    got = collections.Counter((r["n_words"], r["n_removed"]) for r in substring_dedup.removed_words(df).collect())
    assert got == {(4, 0): 59_940, (41, 40): 60, (41, 41): 40_000}
    left = collections.Counter(r["text"] for r in substring_dedup.remove_repeats(df).where("length(text) < 9 and text not like '% %'").collect())
    assert left == {"": 40_000} | {f"n{i}": 1 for i in range(0, 60_000, 1000)}


@pytest.mark.parametrize("at_once", [700_000, 50])
def test_repeats_equal_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(substring_dedup, "ENTRIES_AT_ONCE", at_once)
    draw = random.Random(2)
    passage = prose(draw, 60)
    texts = [None, "", " \n ", "one", " ".join(prose(draw, 34)), " ".join(prose(draw, 35))]
    for n in (0, 1, 5, 20, 33):
        texts.append("\n".join(prose(draw, n) + passage[n : n + 34 + n] + prose(draw, 9)))
    texts += [texts[5], "same " * 200, " ".join(passage * 3), " ".join(prose(draw, 3000) + passage)]
    rows = list(enumerate(texts)) + [(4, texts[4] + " x"), (None, texts[6])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_words(df).collect())
    assert got == collections.Counter((i, *x) for (i, _), x in zip(rows, cut([t for _, t in rows], 35), strict=True))
    new = substring_dedup.remove_repeats(df)
    assert new.columns == df.columns and new.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in new.collect()}
    assert kept[0] is None and kept[2] == " \n " and kept[12] == ""
    assert substring_dedup.removed_words(df.limit(0)).count() == 0


# Benchmark.


def scanned(docs, items):
    grams = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall(lowered(t)), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found |= {str(x) for x in grams[tuple(w[j : j + n])] if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return collections.Counter(out)


@pytest.mark.parametrize("most,most_bytes", [(50_000, 0), (3, 1 << 20), (3, 0)])
def test_scan_equals_brute_force(spark, most, most_bytes):
    draw = random.Random(5)
    items = [(i, " ".join(prose(draw, n))) for i, n in enumerate([25, 12, 10, 9, 3, 1, 0])] + [(10, None), (11, "  ,, "), (2, "Ünï-Code x"), (None, "z9")]
    docs = [(0, None), (1, ""), (2, "nothing here")]
    for i, t in items:
        if t:
            w = t.split()
            docs += [(10 + (i or 0), " ".join(prose(draw, 5) + w + prose(draw, 5))), (40 + (i or 0), ". ".join(w).upper()), (70, " ".join(w[1:]) + " " + w[0])]
    docs += [(90, " ".join(prose(draw, 3000) + items[0][1].split()[:14] * 3)), (70, "z9 Z9")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(d, b, most_grams=most, most_bytes=most_bytes)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = scanned(docs, items)
    assert collections.Counter(tuple(r) for r in got.select(names).collect()) == want
    d = d.selectExpr("*", "1 as w", "2 as hits", "3 as `h.1`", "4 as uid")
    clean = decontamination.drop_contaminated(d, b, most_grams=most, most_bytes=most_bytes)
    assert clean.columns == d.columns and clean.count() == sum(n for r, n in want.items() if not r[-1])
    assert decontamination.scan(d, b.limit(0), most_grams=most - 3).where("contaminated").count() == 0
    assert decontamination.drop_contaminated(d, b.limit(0), most_grams=most - 3).count() == d.count()
    assert decontamination.scan(d.limit(0), b).count() == 0


def test_a_bound_over_the_usual_one_loses_no_windows(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_GRAMS", 2)
    texts = [(i, f"w{i}") for i in range(6)]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")
    assert decontamination.scan(d, b, most_grams=100).where("contaminated").count() == 6
    assert decontamination.drop_contaminated(d, b, most_grams=100).count() == 0
    with pytest.raises(ValueError):
        decontamination.with_hits(d, decontamination.grams_of(b, "text", "item_id", 10), "text", 5)


# Mixing.


def test_targets_stop_at_three_times_the_size(spark):
    rows = [("a", 1000), ("b", 10), ("c", 300), (None, 50), ("B", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in rows if s is not None)) + [None]
    weight, size = {s: 1 + i % 3 for i, s in enumerate(order)}, dict(rows)
    left, want, free = sum(size.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            free.discard(s)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block", [512, 7])
def test_mix_comes_near_the_targets(spark, block):
    draw = random.Random(block)
    docs = [(i, " ".join("w" for _ in range(draw.choice([0, 1, 5, 40, 900]))), draw.choice(["a"] * 9 + ["b", "c", None])) for i in range(300)]
    docs += [(5, docs[5][1], docs[5][2]), (None, "x y", "d"), (400, None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = [tuple(r) for r in mixing.mix(df, block=block).collect()]
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, (tuple(r) for r in mixing.mix(df.repartition(3), block=block).collect())))
    taken, target = collections.Counter(), {}
    for _, size, whole, goal, n, source, first, slots in rows:
        assert 0 <= n <= 3 * size and (first is None) == (n == 0) == (slots == 0)
        taken[source] += n
        target[source] = goal
    assert all(abs(taken[s] - g) <= 1 for s, g in target.items())
    assert mixing.mix(df.limit(0)).count() == 0


def scheduled(shares, block, point=lambda i: i * mixing.GOLDEN % (1 << 60)):
    """The slots of each source and its whole target, by the golden-ratio points one after another."""
    shares = sorted(((s, int(t)) for s, t in shares if t >= 1), key=lambda x: (x[0] is None, x[0] or ""))
    total, ends, cum = sum(n for _, n in shares), [], 0
    for s, n in shares:
        cum += n
        ends.append((s, int(cum / total * 2.0**60)))
    got = {s: [] for s, _ in shares}
    points = -(-total // block)
    for slot in range(points):
        got[next(s for s, e in ends if point(slot) < e)].append(slot)
    for i, (s, _) in enumerate(shares):  # what no point meets stands behind
        got[s] = got[s] or [points + i]
    return got, dict(shares)


@pytest.mark.parametrize("block", [3, 100])
def test_slots_equal_brute_force(spark, block):
    draw = random.Random(block)
    shares = [(f"s{i}", float(draw.choice([0, 1, 2, 50, 5000]))) for i in range(200)] + [(None, 77.5), ("zz", 30000.0)]
    want, whole = scheduled(shares, block)
    rows = mixing.schedule(spark.createDataFrame(shares, "source string, target double"), block).collect()
    got = {s: sorted((r["rank"], r["slot"]) for r in rows if r["source"] == s) for s in want}
    assert got == {s: list(enumerate(slots)) for s, slots in want.items()} and len(rows) == sum(map(len, want.values()))
    for r in rows:
        assert (r["base"], r["extra"]) == divmod(whole[r["source"]], len(want[r["source"]]))
    # a source's slots are spread over the whole mix: every fifth of it has about as many
    zz = np.bincount([slot * 5 // (-(-sum(whole.values()) // block)) for slot in want["zz"]], minlength=5)
    assert zz.max() - zz.min() <= 3


def test_points_are_exact(spark):
    ids = [0, 1, 2, 3, 10**6, 2**31 + 5, 2**40 + 12345]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.point(mixing.F.col("id"))).collect()
    assert [r[1] for r in rows] == [i * mixing.GOLDEN % (1 << 60) for i in ids]


@pytest.mark.parametrize("point", [None, 0])
def test_slots_of_documents_equal_brute_force(spark, monkeypatch, point):
    """Each document's words by its place among its source's shuffled documents, laid end to end up to the target, and cut
    by the slots that the points give the source; other points give other slots."""
    if point is not None:
        monkeypatch.setattr(mixing, "point", lambda n: mixing.F.lit(point).cast("long"))
    draw = random.Random(21)
    docs = [(i, " ".join("w" for _ in range(draw.choice([0, 1, 7, 60]))), draw.choice(["a", "a", "a", "b", None])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = [r.asDict() for r in mixing.mix(df, block=16).collect()]
    assert len(rows) == 120
    hashes = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "xxhash64(doc_id, source, text) as h").collect()}
    slots, whole = scheduled({(r["source"], r["target"]) for r in rows}, 16, *[] if point is None else [lambda i: point])
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source and r["size"]]
        own.sort(key=lambda r: (hashes[r["doc_id"]], r["doc_id"]))  # small sources are one bucket
        words = [r["doc_id"] for r in own for _ in range(r["size"])]
        base, extra = divmod(whole[source], len(slots[source]))
        ends = np.cumsum([base + (i < extra) for i in range(len(slots[source]))])
        taken, inside = collections.Counter(), collections.defaultdict(set)
        for i in range(whole[source]):
            doc = words[i % len(words)]
            taken[doc] += 1
            inside[doc].add(slots[source][int(np.searchsorted(ends, i, side="right"))])
        for r in own:
            i = r["doc_id"]
            assert (r["taken"], r["n_slots"], r["first_slot"]) == (taken[i], len(inside[i]), min(inside[i], default=None))


def test_null_ids_are_shuffled_by_their_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WORDS_PER_BUCKET", 50)
    docs = [(None, f"w{i} x y", "a", "extra") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    assert sum(r["taken"] for r in mixing.mix(df).collect()) == 600


# Sketches.


def test_sketches_give_back_what_differs():
    draw = random.Random(1)
    pairs = []
    for n, m in ((0, 0), (0, 3), (5, 5), (40, 0), (300, 200), (3, 3000)):
        a = [draw.getrandbits(64) for _ in range(n)]
        b = a[: n // 2] + [draw.getrandbits(64) for _ in range(m)]
        pairs.append((a, b))
    only_a, only_b = sketches.differing([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), x, y in zip(pairs, only_a, only_b, strict=True):
        assert sorted(x) == sorted(set(a) - set(b)) and sorted(y) == sorted(set(b) - set(a))


def test_fingerprints_can_be_compared_alone():
    a, b = (sketches.digests(t) for t in ("One two. Three four.\nFive.", "One two. Three four.\nSix."))
    left, right = (sketches.read_fingerprint(sketches.fingerprints([x])[0]) for x in (a, b))
    _, digest, sign, done = left.subtract(right).peel()
    assert done.all() and {int(d) for d, s in zip(digest, sign, strict=True) if s > 0} == set(a) - set(b)


def test_edits_equal_brute_force(spark):
    draw = random.Random(9)
    texts = [None, "", "x", "ab", "Équal text. Twice."] + [". ".join(" ".join(prose(draw, 7)) for _ in range(draw.randint(1, 60))) for _ in range(60)]
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(None, "last. of. all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in sketches.fingerprint_edits(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        a, b, c = (collections.Counter(sketches.digests(x)) for x in (t, new, following))
        like = lambda x, y: sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(new))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(a, b), like(a, c)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (a == b)
    one = spark.createDataFrame([(1, "abc"), (1, "abc")], "doc_id long, text string")
    assert [r["near_next"] for r in sketches.fingerprint_edits(one).collect()] == [1.0, 1.0]
    assert sketches.fingerprint_edits(one.limit(1)).first()["near_next"] == 1.0
    assert sketches.fingerprint_edits(one.limit(0)).count() == 0


# Pages.


def test_rows_of_one_id_follow_by_their_texts(spark):
    draw = random.Random(10)
    texts = [" ".join(prose(draw, draw.randint(1, 9))) for _ in range(6000)] + ["long. " * 30_000]
    df = spark.createDataFrame([(None, t, 1) for t in texts] + [(i, "x", 1) for i in range(50)], "doc_id long, text string, key int").repartition(3)
    got = collections.Counter((r["n_chars"], r["edited_sha256"]) for r in sketches.fingerprint_edits(df).where("doc_id is null").collect())
    hashed = df.where("doc_id is null").selectExpr("text", "xxhash64(text) as h").collect()
    order = [r["text"] for r in sorted(hashed, key=lambda r: r["h"], reverse=True)] + ["x"]
    assert got == collections.Counter((len(t), sha(sketches.edited(t, following))) for t, following in zip(order, order[1:], strict=False))


def test_lists_that_never_peel_are_compared(monkeypatch):
    a, b = [[5, 5, 7, 9]], [[7, 8]]  # a digest twice can't be peeled
    monkeypatch.setattr(sketches, "RETRIES", 3)
    assert [sorted(x[0]) for x in sketches.differing(a, b)] == [[5, 5, 9], [8]] and sketches.likeness(a, b) == [1 / 5]


def test_repeated_runs_equal_brute_force():
    draw = np.random.default_rng(4)
    tokens, pages = draw.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    got = html_text.repeated(tokens, pages)
    want = np.zeros(400, dtype=bool)
    runs = collections.defaultdict(set)
    inside = [i for i in range(393) if pages[i] == pages[i + 7]]
    for i in inside:
        runs[tuple(tokens[i : i + 8])].add(pages[i])
    for i in inside:
        if len(runs[tuple(tokens[i : i + 8])]) > 1:
            want[i : i + 8] = True
    assert (got == want).all() and want.any() and not want.all()


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><a>Home</a></nav><!-- ad --><div class="ad">Buy</div>'
    "<div class='cookie-notice'>We use</div><article><h1>One &amp; two</h1><p><b>Bo</b>ld<br>new&nbsp;line<p>a   b\n c<form>x<input></form><div class=\"comments\"><article>nice</article></div></article>"
    "<aside>see</aside><footer>&copy;</footer></body></html>"
)


def test_blocks_of_a_page():
    def text(page):
        return html_text.main_texts([html_text.blocks(page)])[0]

    assert text(PAGE) == "One & two Bold new line a b c"
    assert text("<main>hi<aside>no</aside> you &lt;3</main><article class=comment>z</article>") == "hi you <3"
    assert text("<div class='sidebar-right layout'><article>in</article></div>") == "in"
    assert text("") == text("<script>var a = '</p>'") == text("<nav>x") == ""
    for kept in ('<div class="side-effects">effects text</div>', "the <label>labelled</label> word", '<p class="search-results-of-the-study">found</p>', '<p class="alert-fatigue">tired</p>'):
        assert text(f"<article><p>one</p>{kept}<p>two</p></article>") == "one " + re.sub("<[^>]*>", "", kept) + " two"
    for name in ("cookie-notice", "share-buttons", "related", "side", "widget_3", "promo-box", "social-links top"):
        assert text(f'<article><p>one</p><div class="{name}">gone</div></article>') == "one"
    assert text("<article>one<form><label>gone</label></form></article>") == "one"
    assert text("a <!-- b") == "a" and text("1 < 2 & 3 &unknown; <p hidden>q</p>") == "1 < 2 & 3 &unknown;"


def test_pages_without_marks_lose_what_their_host_repeats(spark):
    shared = "Welcome to our site with very many offers today"
    pages = [(i, f"http://h.com/{i}", f"<div>{shared}</div><p>{i} is all this page says</p>") for i in range(5)] + [(9, None, None), (10, "http://h.com/x", PAGE), (11, "http://h.com/y", PAGE)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i][0] == f"{i} is all this page says"
    assert got[9] == ("", 0) and got[10] == got[11] == ("One & two Bold new line a b c", 29)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_is_kept():
    def text(page):
        return html_text.main_texts([html_text.blocks(page)])[0]

    assert text("<main>long text</main><div class=related><article>teaser</article></div>") == "long text"
    assert text("<main>before <article>inside</article> after <div class=related><article>teaser</article></div></main>") == "before inside after"
    assert text("<div class=sidebar><main>a <article>b</article> c</main></div><p>d</p>") == "a b c"
    words = " ".join(f"w{i}" for i in range(30))
    copies = [html_text.blocks(f"<p>{words}</p>")] * 2
    assert html_text.main_texts(copies) == [words, words]
    assert html_text.main_texts([*copies, html_text.blocks(f"<p>own {words}</p>")]) == ["", "", "own"]


def test_runs_are_sought_over_the_whole_host(spark):
    draw = random.Random(8)
    pages, streams = [], []
    for i in range(120):  # more than 1 MB on one host; a notice stands on two pages only
        notice = " ".join(f"n{i // 2}-{j}" for j in range(9))
        body = " ".join(f"{draw.randrange(10**9)}" for _ in range(20))
        streams.append(f"<p>{body}</p><p>{notice}</p><!-- {'x' * 10_000} -->")
        pages.append((i % 7, "http://big.com/a", streams[-1]))
    pages += [(200, "http://other.com/a", streams[0]), (201, "http://other.com/b", "<p>n0-0 n0-1</p>"), (None, "http://big.com/a", streams[5])]
    pages += [(300, "http://mixed.com/a", "<article>x</article><p>one two three four five six seven eight</p>"), (301, "http://mixed.com/b", "<p>y one two three four five six seven eight</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = collections.Counter((r["page_id"], r["url"], r["text"]) for r in html_text.extract(df).collect())
    want = collections.Counter()
    for host in ("big", "other", "mixed"):
        own = [p for p in pages if host in p[1]]
        want.update((p[0], p[1], t) for p, t in zip(own, html_text.main_texts([html_text.blocks(p[2]) for p in own]), strict=True))
    assert got == want
    texts = [t for _, u, t in got if "big" in u]
    assert len(texts) == 121 and not any("n" in t for t in texts)
    assert got[301, "http://mixed.com/b", "y"] == got[300, "http://mixed.com/a", "x"] == 1


# Licenses.


def test_base_phrases_equal_brute_force(spark):
    draw = random.Random(6)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "mit", "x", "gnu"]
    docs = [(i, draw.choice([" ", "-", ", "]).join(draw.choice(words).title() for _ in range(draw.randint(1, 80)))) for i in range(120)] + [(200, None), (201, ""), (3, "CC BY"), (None, "cc  by")]
    got = collections.Counter(tuple(r)[:6] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = collections.Counter()
    for i, t in docs:
        w = WORD.findall(lowered(t))
        hits = [(j, label) for p, label in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        at = [j for j, _ in hits]
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))] += 1
    assert got == want


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the GNU Lesser General Public License version 2.1 or later.", "gpl,lgpl-2.1-or-later"),
        ("under the Apache License, Version 2.0", "apache-2.0"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("Released under the MIT License.", "mit"),
        ("Permission is hereby granted, free of charge, to any person", "mit"),
        ("Redistribution and use in source and binary forms; BSD 3-Clause", "bsd,bsd-3-clause"),
        ("Copyright (c) 2020 Me. All rights reserved", "copyright,reserved"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("GPL v2 or later", "gpl-2-or-later"),
        ("licensed under the GPL v3", "gpl,gpl-3"),
        ("LGPL v2.1 only", "lgpl-2.1-only"),
        ("MPL v2", "mpl-2.0"),
        ("Apache License v2.0", "apache-2.0"),
        ("CC-BY-SA v4.0", "cc-by,cc-by-sa-4.0"),
        ("GNU General Public License v3.0 or any later version", "gpl,gpl-3-or-later"),
        ("nothing of the kind", ""),
    ],
)
def test_rules(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels and 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(labels)


def test_there_are_hundreds_of_rules():
    assert len(licenses.RULES) > 200 and len({r[1] for r in licenses.RULES}) > 200


def sample(pattern):
    """Words that a signature fits: what it leaves open is left out, of alternatives the first is taken."""
    pattern = pattern.replace("(?:[a-z0-9]+ ){1,6}", "acme ").replace("[0-9]{4}", "2020").replace("[0-9]+", "2").replace("[0-9]", "4").replace(" ?", " ")
    while "(" in pattern:
        pattern = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], pattern)
    return re.sub(r"\w\?", "", re.sub(r"\[(\w)\w*\]", r"\1", pattern))


def test_hand_written_signatures_are_found(spark):
    """Each of them, in a text of its own, is detected: as its label, or by a stronger rule over the same words."""
    lines = [line.split(maxsplit=2) for line in licenses.SIGNATURES.strip().splitlines()]
    assert len(lines) >= 300 and all(int(p) in (1, 2, 3, 4) for _, p, _ in lines) and len({p for _, _, p in lines}) == len(lines)
    docs = [(i, f"So: {sample(p)}.") for i, (_, _, p) in enumerate(lines)]
    rows = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (label, priority, pattern) in enumerate(lines):
        words = sample(pattern)
        stronger = {(name, p) for key, rule, name, p in licenses.RULES for at in range(len(words.split())) if re.match(rule, " ".join(words.split()[at:])) and (p, name != label) >= (int(priority), True)}
        assert label in rows[i] or {name for name, _ in stronger} & set(rows[i]), (label, pattern, rows[i])


def kept_by_brute_force(words):
    found = []
    for at in range(len(words)):
        for i, (key, pattern, label, priority) in enumerate(licenses.RULES):
            if words[at] == key and (m := re.match(pattern, " ".join(words[at:]))):
                size = m[0].count(" ") + 1
                found.append((at, at + size, label, (priority, size, -i, -at)))
    return {a[2] for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and b[3] > a[3] for b in found)}


def test_labels_and_scores_equal_brute_force(spark):
    draw = random.Random(12)
    plain = [re.sub(r"\[cs\]", "c", re.sub(r"\(\?:([^()|]*)[^()]*\)[?]?|[?]", r"\1", line.split(maxsplit=2)[2])) for line in licenses.SIGNATURES.strip().splitlines()]
    parts = [*plain, "gnu general public license version 2 or later", "cc by sa 4 0", "bsd 3 clause", "license mit", "and", "of the", "copyright 2020"]
    docs = [(i, " ".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for i in range(150)] + [(500, "license mit " * 4000), (None, None), (3, ""), (3, "CC BY")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as near", "3 as kept")
    began = time.time()
    got = collections.Counter((r["doc_id"], r["labels"], r["score"]) for r in licenses.scan(df).collect())
    assert time.time() - began < 60
    want = collections.Counter()
    for i, t in docs:
        w = WORD.findall(lowered(t))
        w = w[:100] if i == 500 else w  # the beginning of the long text has all its labels
        labels = kept_by_brute_force(w) | {label for p, label in licenses.BASE.items() if f" {p} " in f" {' '.join(w)} "}
        share = 0.5 / max(len(labels), 1)
        score = 0.0 if not labels else share if any(not re.match(licenses.OPEN, x) for x in labels) else 1 - share
        want[i, ",".join(sorted(labels)), score] += 1
    assert got == want
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><p>A long story</p><article>and its end</article></main>", "A long story and its end"),
        ("<form><article><p>story</p></article></form>", "story"),
        ('<p title="x>Hi', "Hi"),
        ('<p title=">">a</p><p title=x"y>b</p>', "a b"),
        ('<article><header><h1>Head</h1></header><div class="recipe-cookies">dough</div><div class="ad">buy</div><form>x</form></article>', "Head dough"),
        ('<article><p>a</p><section class="comments"><p>first!</p></section></article>', "a"),
    ],
)
def test_ill_formed_and_odd_pages(page, text):
    assert html_text.main_texts([html_text.blocks(page)]) == [text]


def test_long_pages_take_their_time_by_their_length():
    began = time.time()
    for page in ("<a " * 350_000 + '"', "<div>" * 100_000 + "</x>" * 100_000, "<p class='" * 100_000, "<script " * 100_000, "<p>" * 100_000 + "</div>" * 100_000):
        html_text.blocks(page)
    assert time.time() - began < 30
    words = " ".join(f"w{i}" for i in range(200_000))
    assert html_text.main_texts([html_text.blocks(f"<article><p>{words}</p></article>")]) == [words]


def test_pages_of_several_hosts(spark):
    """Runs that one host repeats stay on another; rows and pages that are repeated keep their texts."""
    draw = random.Random(9)
    line = "this line stands on each page of this host and says nothing at all"
    rows = []
    for host in ("a.org", "b.org"):
        for i in range(4):
            own = " ".join(prose(draw, 30))
            rows.append((i, f"http://{host}/{i}", f"<p>{line}</p><p>{own}</p>" if host == "a.org" or i == 0 else f"<p>{own}</p>", own if host == "a.org" else f"{line} {own}" if i == 0 else own))
    rows += [rows[0], (None, None, None, ""), (7, "x", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, packed string")
    got = collections.Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == collections.Counter((i, u, t, len(t)) for i, u, _, t in rows)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 25, 64])
def test_cut_texts_keep_their_columns(spark, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "BYTES_PER_BUCKET", size)
    passage, draw = " ".join(f"p{i}" for i in range(40)), random.Random(2)
    rows = [(1, f"a  b {passage} c", "k", 5, {"x": 1}), (1, f"{passage} d", None, 6, None), (None, None, "z", 7, {}), (4, " ".join(prose(draw, 30_000)), "q", None, None), (5, "", "", 1, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, _places int, `a.b` map<string,int>")
    got = substring_dedup.remove_repeats(df)
    want = [(1, "a b c", *rows[0][2:]), (1, "d", *rows[1][2:]), *rows[2:]]
    assert got.columns == df.columns and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
