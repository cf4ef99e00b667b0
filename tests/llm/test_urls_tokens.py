import random
import time

import pytest

from strandline.llm.token_counts import WordBpe, count_tokens
from strandline.llm.url_filters import RULES, judge_urls

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = public_tokenizers.path("word_bpe_49k.json")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def judged(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


URLS = [
    None, "", "nothing", "http://", "http://com/en/", "https://A.Example.COM/en/71", "http://example.com/en/7?x=/en/8", "http://x.net/de/8", "http://example.net/de/81#a",
    "http://notcom/en/1", "ftp://u@example.org:80/es/1", "http://example.com?/en/7", "http://a,example.com/en/7", "x://org/es/\n2", "http://example.com/en/7://y", "http://a.b.c.d.org/es/",
]


def test_urls_equal_brute_force(spark):
    rules = [*RULES, ("a,example.com", "/en", "block"), ("com", "", "allow"), ("c.d.org", "/es/", "allow"), ("d.org", "/es/", "block")]
    rows = [(i, u, "x") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"]) == split(r["url"])
        assert (r["rule"], r["verdict"]) == judged(r["host"], r["path"], rules), r


def test_many_rules_and_ranges(spark):
    draw = random.Random(0)
    host = lambda: ".".join(draw.choice("abc") for _ in range(draw.randint(1, 4)))
    path = lambda: "/" + "/".join(draw.choice("xy") for _ in range(draw.randint(0, 4)))
    rules = list({(host(), path()): None for _ in range(80)})
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in rules]
    pages = spark.createDataFrame([(i, f"http://{host()}{path()}") for i in range(400)], "page_id long, url string")
    for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        assert (r["rule"], r["verdict"]) == judged(r["host"], r["path"], rules)


def test_no_urls_and_no_rules(spark):
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert judge_urls(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    assert tuple(judge_urls(some, rules).select("rule", "verdict").first()) == (None, "allow")


TEXTS = [
    "", " ", "hello <|endoftext|> World's  aaaaaaa", "<|startoftext|><|endoftext|>", "ΑΣ İx ǅ 123 é don't!!", "中文字\U0001f600", "'S It'S 'll ſs", "e\u0301\u00a0x\u3000y", "a" * 5000, "word " * 3000, "\0\x01", "ab12cd''re",
]


def test_counts_equal_the_library(spark):
    draw = random.Random(1)
    alphabet = "aabcdeethin'sre .,!1234éßΣσ\t\n中<|>"
    texts = TEXTS + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 200))) for _ in range(400)]
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert WordBpe(PATH).count(texts) == want
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, None, 7), (1, TEXTS[1], 7)], "doc_id long, text string, n_tokens long")
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, PATH).collect()}
    assert got == {(i, len(t.encode()), n, n > 2048) for i, (t, n) in enumerate(zip(texts, want, strict=True))} | {(None, 0, 0, False)}
    assert count_tokens(df, PATH).count() == len(texts) + 2
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_long_words_take_their_time_by_their_length():
    bpe, library, draw = WordBpe(PATH), Tokenizer.from_file(PATH), random.Random(6)
    words = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshr", "aé中😀") for n in (257, 300, 1000)] + ["a" * 999, "ab" * 700]
    words += ["".join(draw.choice("etaoinshrdlu") for _ in range(30_000))]
    began = time.time()
    assert bpe.count(words) == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert time.time() - began < 20


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7), (None, None, None, None)], "doc_id long, text string, _text string, `n.tokens` int")
    got = sorted((tuple(r) for r in count_tokens(df, PATH).collect()), key=str)
    assert got == sorted([(1, "x", 7, 3, 2, False)] * 2 + [(None, None, None, 0, 0, False)], key=str)
    pages = spark.createDataFrame([(1, "http://a.com/en/x", 5, "old")] * 3 + [(2, None, 6, "old"), (3, "nothing", 6, None)], "page_id long, url string, best int, rule string")
    rules = spark.createDataFrame([("com", "/en/", "block"), (None, "/", "block"), ("org", None, "block"), ("net", "/", None)], "host string, path string, verdict string")
    got = sorted(tuple(r) for r in judge_urls(pages, rules).select("page_id", "best", "rule", "verdict").fillna("-").collect())
    assert got == [(1, 5, "com/en/", "block")] * 3 + [(2, 6, "-", "allow"), (3, 6, "-", "allow")]
