"""Document fingerprints as invertible Bloom lookup sketches.

A text is the multiset of its paragraphs; a long one is cut on at the ends of sentences and every twelve words. Each paragraph's digest goes into
three cells that sum counts, digests and checks. Sketches of two versions are subtracted, which leaves the paragraphs
that differ, and peeled: a cell with one of them gives away its digest, which is then taken out of its other cells. If
some cells don't empty, both texts are sketched again with four times as many cells.

All texts of a batch are sketched and peeled at once, their cells behind one another in one array.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of, shuffle_partitions

#: Cells of a fingerprint, in three tables; the factor of a retry; digests that are handled at once.
CELLS, LARGER, DIGESTS_AT_ONCE = 24, 4, 200_000
#: Sketches that are tried, the last with 4 ** 11 times the cells of a fingerprint.
RETRIES = 12
#: Words of a paragraph at most.
WORDS = 12
_ENDS = re.compile(r"\n+|(?<=[.!?…。])\s+")
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


def digests(text: str) -> list[int]:
    """A digest of each paragraph; the second of two equal ones differs from the first, and so on."""
    seen: dict[str, int] = {}
    out = []
    for part in _ENDS.split(text):
        words = part.split()
        for i in range(0, len(words), WORDS):
            piece = " ".join(words[i : i + WORDS])
            seen[piece] = n = seen.get(piece, -1) + 1
            out.append(xxhash.xxh64_intdigest(piece, n))
    return out


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _check(digest: np.ndarray) -> np.ndarray:
    return (_mix(digest, 7) >> np.uint64(32)).astype("u4")


def _places(digest: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest in the array of all owners' cells."""
    third = np.uint64(cells // 3)
    return np.concatenate([owner * cells + k * (cells // 3) + (_mix(digest, cells + k + 11) % third).astype("i8") for k in range(3)])


class Sketches:
    """The cells of n sketches of the same size."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.digest, self.checks = np.zeros(n * cells, dtype="i4"), np.zeros(n * cells, dtype="u8"), np.zeros(n * cells, dtype="u4")

    def add(self, digest: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        at = _places(digest, owner, self.cells)
        np.add.at(self.count, at, np.tile(np.broadcast_to(np.asarray(sign, dtype="i4"), digest.shape), 3))
        np.bitwise_xor.at(self.digest, at, np.tile(digest, 3))
        np.bitwise_xor.at(self.checks, at, np.tile(_check(digest), 3))
        return at

    def strings(self) -> list[str]:
        cells = np.empty(self.n * self.cells, dtype=_CELL)
        cells["count"], cells["digest"], cells["check"] = self.count, self.digest, self.checks
        raw, size = cells.tobytes(), self.cells * _CELL.itemsize
        return [base64.b64encode(raw[i : i + size]).decode() for i in range(0, len(raw), size)]

    def subtract(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.digest, out.checks = self.count - other.count, self.digest ^ other.digest, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the cells as far as it goes: owner, digest and sign of what came out, and which owners' cells are empty."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            at = np.unique(at)
            at = at[(np.abs(self.count[at]) == 1) & (_check(self.digest[at]) == self.checks[at])]
            owner, digest = at // self.cells, self.digest[at]
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], self.count[at[order]]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])][: len(at)]
            owner, digest, sign = owner[new], digest[new], sign[new]
            if not len(owner):
                break
            found.append((owner, digest, sign))
            at = self.add(digest, owner, -sign)
        full = (self.count != 0) | (self.digest != 0) | (self.checks != 0)
        done = ~full.reshape(self.n, self.cells).any(axis=1)
        if not found:
            return np.empty(0, dtype="i8"), np.empty(0, dtype="u8"), np.empty(0, dtype="i4"), done
        return *(np.concatenate(x) for x in zip(*found, strict=True)), done


def read_fingerprint(text: str) -> Sketches:
    cells = np.frombuffer(base64.b64decode(text), dtype=_CELL)
    out = Sketches(1, len(cells))
    out.count, out.digest, out.checks = cells["count"].copy(), cells["digest"].copy(), cells["check"].copy()
    return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in lists]
    return np.array([d for x in lists for d in x], dtype="u8"), np.repeat(np.arange(len(lists)), sizes)


def differing(a: list[list[int]], b: list[list[int]], cells: int = CELLS) -> tuple[list[list[int]], list[list[int]]]:
    """For each pair of versions the digests that only the first has and those that only the second has."""
    only_a: list[list[int]] = [[] for _ in a]
    only_b: list[list[int]] = [[] for _ in a]
    left = np.arange(len(a))
    for _ in range(RETRIES):
        if not len(left):
            return only_a, only_b
        sketches = Sketches(len(left), cells)
        sketches.add(*_flat([a[i] for i in left]))
        other = Sketches(len(left), cells)
        other.add(*_flat([b[i] for i in left]))
        owner, digest, sign, done = sketches.subtract(other).peel()
        for o, d, s in zip(owner.tolist(), digest.tolist(), sign.tolist(), strict=True):
            if done[o]:
                (only_a if s > 0 else only_b)[left[o]].append(d)
        left, cells = left[~done], cells * LARGER
    for i in left:  # two digests of a list are equal, or hash alike: the lists themselves are compared
        only_a[i], only_b[i] = list((Counter(a[i]) - Counter(b[i])).elements()), list((Counter(b[i]) - Counter(a[i])).elements())
    return only_a, only_b


def likeness(a: list[list[int]], b: list[list[int]]) -> list[float]:
    """Shared paragraphs as a part of all, from what the sketches give away; two empty texts are alike."""
    out = []
    for x, y, p, q in zip(a, b, *differing(a, b), strict=True):
        union = len(x) + len(q)
        shared = len(x) - len(p)
        if len(y) - len(q) != shared:  # a cell gave away a digest that neither has
            shared = sum((Counter(x) & Counter(y)).values())
            union = len(x) + len(y) - shared
        out.append(shared / union if union else 1.0)
    return out


def fingerprints(lists: list[list[int]]) -> list[str]:
    out = Sketches(len(lists), CELLS)
    out.add(*_flat(lists))
    return out.strings()


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _rows(texts: list[str]) -> Iterator[tuple]:
    """For all texts but the last, whose next text is the one behind: n_chars, edited_sha256, fingerprints, likenesses."""
    start = 0
    while start < len(texts) - 1:
        stop, size = start, 0
        while stop < len(texts) - 1 and size < DIGESTS_AT_ONCE * 40:  # about 40 letters a paragraph
            size += len(texts[stop])
            stop += 1
        own = texts[start : stop + 1]
        changed = [edited(a, b) for a, b in zip(own, own[1:], strict=False)]
        lists, new = [digests(t) for t in own], [digests(t) for t in changed]
        yield from zip(map(len, own[:-1]), (hashlib.sha256(t.encode()).hexdigest() for t in changed), fingerprints(lists[:-1]), fingerprints(new), likeness(lists[:-1], new), likeness(lists[:-1], lists[1:]), strict=True)
        start = stop


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _following(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a range in descending order, then a row or more of the next range, of which the first is used."""
    unpacker = zstandard.ZstdDecompressor()
    key, held, ended = None, None, False
    for batch in batches:
        own = int((~batch["context"]).sum())
        use = batch.iloc[: own + 1] if own < len(batch) else batch  # the first row of another range stands last
        if ended or not len(use):
            continue
        ended = own < len(batch)
        texts = [unpacker.decompress(p).decode() for p in use["packed"]]
        keys = use["key"].tolist()
        if held is not None:
            texts, keys = [held, *texts], [key, *keys]
        yield pd.DataFrame([(k, *row) for k, row in zip(keys, _rows(texts), strict=False)], columns=["key", *COLUMNS])
        key, held = keys[-1], texts[-1]


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text has its last third replaced by as much of the beginning of the next document, in descending order of
    ids (rows that repeat an id by a hash of their texts, null ids last; after the last comes the first). Null and empty
    texts have the fingerprint of no paragraphs and are like each other. A single row follows itself. An empty table
    gives an empty result.

    Texts are used whole, however long; other columns, whatever their names, don't count.

    Ranges of ids are cut at approximate quantiles, and an id that several quantiles fall on is cut on by the hashes of its
    texts, which are uniform; a range also gets the first row of the range that follows it.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(key_of(F.col(f"`{doc_id}`")).alias("key"), F.xxhash64(whole).alias("mark"), whole.alias("text"))
    found = texts.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], F.lit(20 * ranges + 1000))).first()[0]
    # a range begins at its cut: with the first row of an id, or within its hashes
    cuts = [(key, -(1 << 63) + (i << 64) // n) for key, n in sorted(Counter(found or []).items()) for i in range(n)]
    cut_keys, cut_marks = (np.array([c[i] for c in cuts], dtype="i8") for i in (0, 1))

    def places(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """How many cuts stand at or before each row."""
        first, last = np.searchsorted(cut_keys, keys), np.searchsorted(cut_keys, keys, side="right")
        out = first.astype("i4")
        for i in np.flatnonzero(first < last):
            out[i] += np.searchsorted(cut_marks[first[i] : last[i]], marks[i], side="right")
        return out

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(places(keys.to_numpy(), marks.to_numpy()), dtype="int32")

    top = texts.select("key", "mark", range_of("key", "mark").alias("range")).groupBy("range").agg(F.max(F.struct("key", "mark")).alias("top"))
    firsts = {r["range"]: (r["top"]["key"], r["top"]["mark"]) for r in top.collect()}  # one row a range
    filled = sorted(firsts)
    before = {firsts[q]: filled[(i + 1) % len(filled)] for i, q in enumerate(filled)}  # the range that comes before, in descending order
    first_keys = np.array(sorted({key for key, _ in before}), dtype="i8")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keys, marks = batch["key"].to_numpy(), batch["mark"].to_numpy()
            out = pd.DataFrame({"key": keys, "mark": marks, "packed": [packer.compress(t.encode()) for t in batch["text"]]})
            out["range"], out["context"] = places(keys, marks), False
            near = [i for i in np.flatnonzero(np.isin(keys, first_keys)) if (keys[i], marks[i]) in before]
            more = out.iloc[near].copy()
            more["range"], more["context"] = np.array([before[keys[i], marks[i]] for i in near], dtype="i4"), True
            yield pd.concat([out, more])

    dealt = texts.mapInPandas(deal, "key long, mark long, packed binary, range int, context boolean").repartitionById(ranges, "range")
    dealt = dealt.sortWithinPartitions("context", F.desc("key"), F.desc("mark"))
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(_following, schema).select(id_of(F.col("key")).alias("doc_id"), *COLUMNS)
