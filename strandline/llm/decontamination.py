"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark are one hash set that goes to every task as part of the plan, behind a check of its size.
A document's word windows are hashed by doubling: hashes of windows of 2, 4 and 8 words are combined from those of half
the width, so a window of ten costs two hashes more. Windows with a hash in the set are verified on their words.

A larger benchmark doesn't fit into a plan. Its windows are then a table that is broadcast up to a checked number of
bytes, and beyond that shuffled by hash; either way only places whose hash is known are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of the benchmark that may be in the plan, and bytes of them that may be broadcast as a table.
MOST_GRAMS, MOST_BYTES = 50_000, 256 << 20


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def grams_of(benchmark: DataFrame, text: str, item_id: str, window: int) -> DataFrame:
    """item_id (as a string), gram (words joined by a space), len: the windows of each item, a short item as one."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), split_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return items.select("item_id", size.alias("len"), "w", F.explode(starts).alias("at")).select("item_id", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("gram")).distinct()


def _width_columns(longest: int) -> list[int]:
    return [1 << i for i in range(longest.bit_length()) if 1 << i <= longest]


def _joined(left: str, right: str, by: int) -> Column:
    """Hashes of windows made of a left part and the right part that begins `by` words later."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), F.least(n, F.size(left))), F.slice(right, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """docs (with words w) and an array column h<n> of the hashes of its windows of n words, for each n asked for."""
    docs = docs.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    done = {1}
    for wide in _width_columns(max(lengths, default=1))[1:]:
        docs = docs.withColumn(f"h{wide}", _joined(f"h{wide // 2}", f"h{wide // 2}", wide // 2))
        done.add(wide)
    for n in lengths:
        at = 0
        for wide in reversed(_width_columns(n)):
            if not n & wide:
                continue
            if at and at + wide not in done:
                docs = docs.withColumn(f"h{at + wide}", _joined(f"h{at}", f"h{wide}", at))
                done.add(at + wide)
            at += wide
    return docs


def with_hits(docs: DataFrame, grams: DataFrame, text: str, most_grams: int = MOST_GRAMS) -> DataFrame:
    """docs with w (its words) and hits (array of struct at, len, gram): its windows that are windows of the benchmark.

    More than most_grams windows of the benchmark are an error.
    """
    known = grams.select("len", "gram").distinct()
    by_len: dict[int, list[str]] = {}
    rows = known.limit(most_grams + 1).collect()
    if len(rows) > most_grams:
        raise ValueError(f"the benchmark has more than {most_grams} windows")
    for row in rows:
        by_len.setdefault(row["len"], []).append(row["gram"])
    docs = docs.withColumn("w", split_words(F.col(text)))
    if not by_len:
        return docs.withColumn("hits", F.expr("cast(array() as array<struct<at:int,len:int,gram:string>>)"))
    lengths = sorted(by_len)
    docs = with_window_hashes(docs, lengths)
    hashed = with_window_hashes(known.withColumn("w", F.split("gram", " ")), lengths)
    sets: dict[int, list[int]] = {}
    for row in hashed.select("len", F.coalesce(*(F.when(F.col("len") == n, F.col(f"h{n}")[0]) for n in lengths)).alias("h")).collect():
        sets.setdefault(row["len"], []).append(row["h"])

    def places(n: int) -> Column:
        marked = F.transform(f"h{n}", lambda h, i: F.when(h.isin(sets[n]), i))
        return F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len")))

    docs = docs.withColumn("places", F.concat(*(places(n) for n in lengths)))
    grams_at = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["len"].alias("len"), F.array_join(F.slice("w", p["at"] + 1, p["len"]), " ").alias("gram")))
    docs = docs.withColumn("found", F.when(F.size("places") > 0, grams_at).otherwise(F.expr("cast(array() as array<struct<at:int,len:int,gram:string>>)")))
    return docs.withColumn("hits", F.filter("found", lambda x: x["gram"].isin([g for gs in by_len.values() for g in gs])))


def _text_key(text: Column) -> Column:
    """Tells texts apart, however often they are read; rows of one text are hit alike."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def _wide_hits(docs: DataFrame, grams: DataFrame, text: str, most_bytes: int) -> DataFrame:
    """uid (of a text), at, len, gram: each text's windows that are windows of the benchmark, for one of any size."""
    known = grams.select("len", "gram").distinct()
    size = known.agg(F.sum(F.octet_length("gram") + 32), F.collect_set("len")).first()
    lengths = sorted(size[1])
    docs = docs.select(_text_key(F.col(text)).alias("uid"), split_words(F.col(text)).alias("w"))
    if not lengths:
        return docs.limit(0).select("uid", F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("gram"))
    hashed = with_window_hashes(known.withColumn("w", F.split("gram", " ")), lengths)
    known = hashed.select("len", "gram", F.coalesce(*(F.when(F.col("len") == n, F.col(f"h{n}")[0]) for n in lengths)).alias("h"))

    def places(n: int) -> Column:
        return F.transform(f"h{n}", lambda h, i: F.struct(i.alias("at"), F.lit(n).alias("len"), h.alias("h")))

    each = F.concat(*(places(n) for n in lengths))
    docs = with_window_hashes(docs, lengths)
    if (size[0] or 0) <= most_bytes:
        found = docs.select("uid", "w", F.inline(each)).join(F.broadcast(known), ["len", "h"])
    else:
        places = docs.select("uid", F.inline(each)).join(known, ["len", "h"]).groupBy("uid").agg(F.collect_set(F.struct("at", "len", "gram")).alias("places"))
        found = docs.select("uid", "w").join(places, "uid").select("uid", "w", F.inline("places"))
    return found.where(F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ") == F.col("gram")).select("uid", "at", "len", "gram").distinct()


def _union_size(spans: Column) -> Column:
    """Words that the spans (at, len) cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(seen: Column, s: Column) -> Column:
        end = (s["at"] + s["len"]).cast("long")
        return F.struct((seen["n"] + F.greatest(end - F.greatest(seen["end"], s["at"].cast("long")), F.lit(0).cast("long"))).alias("n"), F.greatest(seen["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda seen: seen["n"])


def _in_plan(grams: DataFrame, most_grams: int) -> bool:
    return grams.select("len", "gram").distinct().limit(most_grams + 1).count() <= most_grams


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW, most_grams: int = MOST_GRAMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. n_hit: the words
    inside any occurrence of a window; items: those with such windows, each once, however often it occurs or is repeated.
    Null and empty texts have no words and no hits; an item without an id still hits, but isn't counted. Texts are used
    whole, however long. Rows that repeat an id stay rows of their own; other columns, whatever their names, don't count.
    Empty tables: no rows, or no hits.
    """
    grams = grams_of(benchmark, text, item_id, window)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans, items = F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "len"))), F.array_sort(F.collect_set("item_id"))
    n_words = F.size(split_words(F.col("text"))).cast("long")
    if _in_plan(grams, most_grams):
        # the number is given and used in one pass, so that it needn't be the same in another
        docs = docs.withColumn("uid", F.monotonically_increasing_id())
        base = with_hits(docs, grams, "text", most_grams).select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), "hits")
        found = base.select("uid", "doc_id", "n_words", F.explode_outer("hits").alias("x")).select("uid", "doc_id", "n_words", "x.at", "x.len", "x.gram")
        few = grams.limit(2 * most_grams + 1).count() <= 2 * most_grams
        found = found.join(F.broadcast(grams) if few else grams, ["len", "gram"], "left")
        out = found.groupBy("uid", "doc_id", "n_words").agg(_union_size(spans).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"))
        return out.drop("uid").withColumn("contaminated", F.col("n_hit") > 0)
    hits = staged(_wide_hits(docs, grams, "text", most_bytes), "benchmark-hits")
    words = hits.groupBy("uid").agg(_union_size(spans).alias("n_hit"))
    named = hits.select("uid", "len", "gram").distinct().join(grams, ["len", "gram"]).groupBy("uid").agg(items.alias("items"))
    found = staged(words.join(named, "uid"), "benchmark-texts")
    base = docs.select("doc_id", n_words.alias("n_words"), _text_key(F.col("text")).alias("uid"))
    nothing = F.array().cast("array<string>")
    out = base.join(found, "uid", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, most_grams: int = MOST_GRAMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs without any window of the benchmark, whole; columns stay as they are, whatever their names.

    Rows with null and empty texts stay, as do rows that repeat an id, each on its own text. Empty tables: no rows, or all.
    """
    grams = grams_of(benchmark, text, item_id, window)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{text}`").alias("text"))
    if _in_plan(grams, most_grams):
        # the row number keeps the optimizer from moving the filter, and with it all hashing, into one expression
        found = with_hits(whole, grams, "text", most_grams).select("doc", F.size("hits").alias("n"), F.monotonically_increasing_id().alias("row"))
        return found.where("n = 0 and row >= 0").select("doc.*")
    hits = _wide_hits(whole.select("text"), grams, "text", most_bytes).select("uid").distinct()
    return whole.withColumn("uid", _text_key(F.col("text"))).join(hits, "uid", "left_anti").select("doc.*")
