"""Substring dedup by difference-cover anchors.

A difference cover of a period holds, for any two positions, a shift under the period that brings both onto it. So two
equal windows of 35 words share an anchor, a shorter window that begins at a covered position in both texts, at the same
place. First only the anchors are hashed and shuffled; where an anchor repeats, the match is extended: the full windows
around it are hashed and shuffled in turn, and those that repeat cover words to be removed.

A text is told apart by two hashes of 64 bits over its id and itself; rows equal in both have the same places anyway.

Both shuffles send, for each task and bucket of hashes, one packed row. A task first looks for repeats among its own
texts and sends a hash once, so a passage of any number of documents meets in a bucket once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, id_of, join_salted, key_of, shuffle_partitions, staged

WINDOW = 35
#: A perfect difference cover: every shift from 1 to 20 is a difference of two of these, modulo the period.
PERIOD, COVER = 21, np.array([0, 1, 4, 14, 16])
#: Entries that a task gathers before it packs them, and words whose hashes it remembers.
ENTRIES_AT_ONCE, REMEMBERED = 700_000, 150_000
#: Bytes of text for each bucket of hashes, and each group of texts, about 1.2 million anchors.
BYTES_PER_BUCKET = 32 << 20
#: Odd, so that powers of it can be inverted modulo 2**64.
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype="u8")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype="u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """A hash of each window of `size` words: a polynomial of the words' hashes, shifted to the power 0, mixed."""
    if len(words) < size:
        return np.empty(0, dtype="u8")
    if base:
        words = _mixed(words ^ BASES[base])
    n = len(words)
    sums = np.r_[np.zeros(1, dtype="u8"), np.add.accumulate(words * _powers(int(BASES[base]), n))]
    back = _powers(pow(int(BASES[base]), -1, 1 << 64), n - size + 1)
    return _mixed((sums[size:] - sums[:-size]) * back)


def _pack(*parts: np.ndarray) -> bytes:
    sizes = np.array([len(parts), *(p.nbytes for p in parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(p.tobytes() for p in parts))


def _unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    ends = 8 * (1 + len(kinds)) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], k) for s, e, k in zip(sizes, ends, kinds, strict=True)]


def positions(places: bytes) -> np.ndarray:
    """Packed gaps of sorted positions."""
    return np.cumsum(_unpack(places, "<u4")[0], dtype="i8")


def _group(key: np.ndarray, mark: np.ndarray, groups: int) -> np.ndarray:
    return (_mixed(key.view("u8") ^ mark.view("u8")) % np.uint64(groups)).astype("i8")


def _by_group(key: np.ndarray, mark: np.ndarray, at: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """The places for each group of texts, packed."""
    if not len(key):
        return
    group = _group(key, mark, groups)
    order = np.lexsort((at, mark, key, group))
    group, key, mark, at = group[order], key[order], mark[order], at[order].astype("<u4")
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(first, np.append(first[1:], len(group)), strict=True):
        yield int(group[a]), _pack(key[a:b], mark[a:b], at[a:b])


def _runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where in it each run of them begins."""
    order = np.lexsort((lo, hi))
    a, b = hi[order], lo[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _sent(hashed: Callable, buckets: int) -> Callable:
    """Maps texts to rows bucket, found, payload: packed hashes for a bucket, or packed places that are known to repeat."""

    def flush(parts: list[tuple]) -> pd.DataFrame:
        key, mark, at, hi, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first = _runs(hi, lo)
        size = np.diff(np.append(first, len(order)))
        again = order[np.repeat(size > 1, size)]
        rows = [(group, True, packed) for group, packed in _by_group(key[again], mark[again], at[again], buckets)]
        once, many = order[first], size > 1
        bucket = (hi[once] % np.uint64(buckets)).astype("i8")
        by = np.lexsort((at[once], mark[once], key[once], bucket))
        once, many, bucket = once[by], many[by], bucket[by]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            i = once[a:b]
            rows.append((int(bucket[a]), False, _pack(hi[i], lo[i], key[i], mark[i], at[i].astype("<u4"), many[a:b])))
        return pd.DataFrame(rows, columns=["bucket", "found", "payload"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, parts, n = _WordHashes(), [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                at, hi, lo = hashed(memo, row)
                if len(at):
                    parts.append((np.full(len(at), row.key), np.full(len(at), row.mark), at, hi, lo))
                    n += len(at)
                if n > ENTRIES_AT_ONCE:
                    yield flush(parts)
                    parts, n = [], 0
        if parts:
            yield flush(parts)

    return send


def _met(buckets: int) -> Callable:
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of their buckets: the places of the hashes that more than one task, or one task twice, has."""
        bucket, packed = None, []

        def repeats() -> list[tuple]:
            hi, lo, key, mark, at, many = (np.concatenate(x) for x in zip(*(_unpack(p, "<u8", "<u4", "<i8", "<i8", "<u4", "?") for p in packed), strict=True))
            order, first = _runs(hi, lo)
            size = np.diff(np.append(first, len(order)))
            new = order[np.repeat(size > 1, size)]
            new = new[~many[new]]  # the others' tasks know already
            return list(_by_group(key[new], mark[new], at[new], buckets))

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.bucket != bucket:
                    out += repeats() if packed else []
                    bucket, packed = row.bucket, []
                if row.found:
                    out.append((row.bucket, row.payload))
                else:
                    packed.append(row.payload)
            yield pd.DataFrame(out, columns=["bucket", "payload"])
        if packed:
            yield pd.DataFrame(repeats(), columns=["bucket", "payload"])

    return meet


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of their groups of texts: one row for each text with places."""

    def texts(packed: list[bytes]) -> pd.DataFrame:
        key, mark, at = (np.concatenate(x) for x in zip(*(_unpack(p, "<i8", "<i8", "<u4") for p in packed), strict=True))
        order = np.lexsort((at, mark, key))
        key, mark, at = key[order], mark[order], at[order].astype("i8")
        own = np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (at[1:] != at[:-1])]  # equal rows say the same
        key, mark, at = key[own], mark[own], at[own]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
        places = [_pack(np.diff(at[a:b], prepend=0).astype("<u4")) for a, b in zip(first, np.append(first[1:], len(key)), strict=True)]
        return pd.DataFrame({"key": key[first], "mark": mark[first], "places": places})

    group, packed = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.bucket != group and packed:
                yield texts(packed)
                packed = []
            group = row.bucket
            packed.append(row.payload)
    if packed:
        yield texts(packed)


def _repeated(texts: DataFrame, hashed: Callable, buckets: int) -> DataFrame:
    """key, mark, places (packed positions) of what repeats in texts.

    There are as many buckets as the texts' volume asks for, so that one fits into memory; a partition has several.
    """
    n = shuffle_partitions(texts.sparkSession)
    sent = texts.mapInPandas(_sent(hashed, buckets), "bucket long, found boolean, payload binary")
    of = F.pmod("bucket", F.lit(n)).cast("int")
    met = sent.repartitionById(n, of).sortWithinPartitions("bucket").mapInPandas(_met(buckets), "bucket long, payload binary")
    return met.repartitionById(n, of).sortWithinPartitions("bucket").mapInPandas(_gathered, "key long, mark long, places binary")


def _words(memo: dict, text: bytes) -> np.ndarray:
    found = zstandard.ZstdDecompressor().decompress(text).split()  # at \x20 and \x09-\x0D
    return np.fromiter(map(memo.__getitem__, found), dtype="u8", count=len(found))


def _anchors(window: int) -> Callable:
    size = window - PERIOD + 1

    def hashed(memo: dict, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = _words(memo, row.packed)
        none = np.empty(0, dtype="i8")
        if len(words) < window:
            return none, none.astype("u8"), none.astype("u4")
        hi = window_hashes(words, size)
        at = (np.arange(0, len(hi), PERIOD)[:, None] + COVER).ravel()
        at = at[at < len(hi)]
        return at, hi[at], np.zeros(len(at), dtype="u4")

    return hashed


def _extended(window: int) -> Callable:
    reach = PERIOD - 1

    def hashed(memo: dict, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = _words(memo, row.packed)
        last = len(words) - window
        near = np.zeros(last + 2 + reach, dtype="i4")  # a window begins at its anchor or up to `reach` words before
        at = positions(row.places)
        at = at[at <= last + reach]
        np.add.at(near, np.maximum(at - reach, 0), 1)
        np.add.at(near, np.minimum(at, last) + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[: last + 1] > 0)
        return at, window_hashes(words, window)[at], (window_hashes(words, window, 1)[at] & np.uint64(0xFFFFFFFF)).astype("u4")

    return hashed


KEYS = ["key", "mark"]


def _named(docs: DataFrame, text: str, doc_id: str) -> list[Column]:
    """key and mark: hashes of the id and the text, null as an id of its own and as the empty text."""
    both = (key_of(F.col(f"`{doc_id}`")), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return [F.xxhash64(*both).alias("key"), F.xxhash64(*both[::-1], F.lit(1)).alias("mark")]


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, key, mark and packed (the compressed text)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "mark": batch["mark"], "packed": [packer.compress(t.encode()) for t in batch["text"]]})

    rows = docs.select(key_of(F.col(f"`{doc_id}`")).alias("id"), *_named(docs, text, doc_id), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(pack, "id long, key long, mark long, packed binary")


def _hot(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return hot_keys(docs.select(*_named(docs, text, doc_id)), KEYS)


def _buckets(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BYTES_PER_BUCKET))


def _windows(docs: DataFrame, hot: DataFrame, window: int, text: str, doc_id: str) -> DataFrame:
    """key, mark, places of the windows of texts that repeat."""
    texts, buckets = _texts(docs, text, doc_id), _buckets(docs, text)
    anchors = staged(_repeated(texts, _anchors(window), buckets), "substring-anchors")
    return staged(_repeated(join_salted(texts, anchors, KEYS, hot), _extended(window), buckets), "substring-windows")


def covered(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, key, mark, packed (the text) of each row of docs, and places (packed starts of windows that repeat; null: none)."""
    hot = _hot(docs, text, doc_id)
    return join_salted(_texts(docs, text, doc_id), _windows(docs, hot, window, text, doc_id), KEYS, hot, "left")


def _kept(words: list[bytes], places, window: int) -> np.ndarray:
    keep = np.ones(len(words), dtype=bool)
    if places is not None:
        edge = np.zeros(len(words) + 1, dtype="i4")
        at = positions(places)
        at = at[at + window <= len(words)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
    return keep


def removed_words(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), kept of each row of docs.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D. A word goes if it lies in a window of `window` words that
    also begins anywhere else, in the same text or another; all its occurrences go. Null and empty texts have no words.
    Rows that repeat an id stay rows of their own, and repeated texts repeat each other's windows. Long texts are used
    whole. Other columns, whatever their names, don't count. Empty tables give empty results.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                words = unpacker.decompress(row.packed).split()
                keep = _kept(words, row.places, window)
                kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k) if not keep.all() else b" ".join(words)
                out.append((row.id, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = covered(docs, window, text, doc_id).mapInPandas(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return rows.select(id_of(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with all repeated windows cut out of the text; a text without any stays as it is, white space included.

    Null texts stay null. Long texts are used whole. Rows that repeat an id stay rows of their own, and rows that repeat a
    text repeat each other's windows. Other columns stay as they are, whatever their names. An empty table gives an empty
    result.
    """
    hot = _hot(docs, text, doc_id)
    found = _windows(docs, hot, window, text, doc_id)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, places, strict=True):
            if p is not None:
                words = t.encode().split()
                t = b" ".join(w for w, k in zip(words, _kept(words, p, window), strict=True) if k).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(0).alias(""))
    marked = docs.select(own.alias("row"), F.col(f"`{text}`").alias("text"), *_named(docs, text, doc_id))
    # a text without repeats isn't sent to Python; a null text has none
    shorter = cut(F.when(F.col("places").isNotNull(), F.col("text")), F.col("places"))
    kept = join_salted(marked, found, KEYS, hot, "left").select("row", F.coalesce(shorter, F.col("text")).alias("text"))
    return kept.select(*(F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
