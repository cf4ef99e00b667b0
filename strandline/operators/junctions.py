"""K-mers where they meet: all that end and begin with the same k - 1 bases, or their reverse complement, in one task.

A k-mer goes to the two junctions at its ends, as three numbers in columns of bytes that compress well. A step and its
reverse are at the same junction, so what stands there says which successors a node has, and which steps lead back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmers import BUCKETS, buckets_of, by_bucket, revcomps, spread_hash

#: K-mers, or nodes, that are held at once.
AT_ONCE = 1 << 18
_SLOTS = range(4)
_U = np.uint64


def _entries(kmer: np.ndarray, cnt: np.ndarray, plus: np.ndarray, k: int) -> list[np.ndarray]:
    """(junction and slot, cnt, plus) of k-mers. Slot: the base before the junction, or 4 and the base behind it."""
    back, mask, top = revcomps(kmer, k), _U((1 << 2 * (k - 1)) - 1), _U(2 * (k - 1))
    out = []
    for src, turned in ((kmer, back), (back, kmer)):
        once = np.ones(len(src), bool) if src is kmer else src != turned
        before, behind = src & mask, src >> _U(2)
        for junction, own, slot in ((before, turned >> _U(2), src >> top), (behind, turned & mask, _U(4) | src & _U(3))):
            at = np.flatnonzero(once & (junction <= own))
            out.append(((junction[at] << _U(3) | slot[at]), cnt[at], plus[at]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches put together to at least so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += len(batch)
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(_U).ravel()


def _forks_at(key: np.ndarray, cnt: np.ndarray, plus: np.ndarray, k: int, low_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, counts of its successors, 0 for none, their plus fractions), the rows of a junction together."""
    order = np.argsort(key)
    key, cnt, plus = key[order], cnt[order], plus[order]
    place = key >> _U(3)
    new = np.r_[True, place[1:] != place[:-1]]
    at, slot, junction = new.cumsum() - 1, (key & _U(7)).astype(np.int64), place[new]
    n = len(junction)
    counts, part = np.zeros((n, 8), np.int64), np.zeros((n, 8))
    counts[at, slot] = cnt
    part[at, slot] = np.floor(plus / cnt * 65535 + 0.5).astype(np.int64) / 65535
    as_is = np.stack([_U(b) << _U(2 * (k - 1)) | junction for b in _SLOTS] + [junction << _U(2) | _U(c) for c in _SLOTS], axis=1)
    turned = revcomps(as_is, k)
    node = np.minimum(as_is, turned)
    out = []
    one_way = junction == revcomps(junction, k - 1)
    for first, then, src, flip in ((0, 4, as_is, as_is > turned), (4, 0, turned, turned > as_is)):
        frac = np.where(flip, 1 - part, part)
        for i in _SLOTS:
            rows = counts[:, first + i] > 0
            if first:
                rows &= ~one_way  # both ways are the same there
            rows = np.flatnonzero(rows)
            to = [then + (b ^ 2 if first else b) for b in _SLOTS]
            met = np.where(node[rows][:, to] != node[rows, first + i][:, None], counts[rows][:, to], 0)
            met[met < low_count] = 0
            some = met.any(axis=1)
            out.append((rows[some], src[rows, first + i][some], met[some], frac[rows][:, to][some]))
    rows, src, met, frac = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(rows, kind="stable")
    return src[order], met[order], frac[order]


def forks_of(kmers: DataFrame, k: int, low_count: int) -> DataFrame:
    """src, c0-c3, f0-f3 of packed k-mers (kmer, cnt, plus), as graph.forks_of has them; the rows of a junction stand together."""
    n = int(kmers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kmer, cnt, plus in _held(batches, AT_ONCE):
            key, *values = _entries(kmer.astype(_U), cnt, plus, k)
            bucket = spread_hash(key >> _U(3), n * BUCKETS)
            order = np.lexsort((key, bucket))
            bucket = bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            columns = [[_planes(x) for x in np.split(y[order], first[1:])] for y in (key, *values)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "key", "cnt", "plus"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            key, cnt, plus = (np.concatenate([_numbers(x) for x in c]) for c in zip(*rows, strict=True))
            src, met, frac = _forks_at(key, cnt.astype(np.int64), plus.astype(np.int64), k, low_count)
            none = met == 0
            arrays = [pa.array(x[:, i], mask=none[:, i]) for x in (met, frac) for i in _SLOTS]
            yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), *arrays], ["src", *(f"{x}{i}" for x in "cf" for i in _SLOTS)])

    dealt = kmers.select("kmer", F.col("cnt").cast("long"), F.col("plus").cast("long")).mapInArrow(deal, "bucket int, key binary, cnt binary, plus binary")
    kinds = ", ".join(["src long", *(f"c{i} long" for i in _SLOTS), *(f"f{i} double" for i in _SLOTS)])
    return by_bucket(dealt, n).mapInArrow(meet, kinds)


def unique_edges(forks: DataFrame, k: int) -> DataFrame:
    """src, dst: a node's only successor that has, walked back, the node as its only one. forks: forks_of, with less
    successors, but read from no table, so that the rows of a junction stand together."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for src, *slots in _held(batches, AT_ONCE):
            rows = [src, *slots] if carried is None else [np.r_[a, b] for a, b in zip(carried, [src, *slots], strict=True)]
            suffix = rows[0].astype(_U) & _U((1 << 2 * (k - 1)) - 1)
            junction = np.minimum(suffix, revcomps(suffix, k - 1))
            open_from = np.flatnonzero(np.r_[True, junction[1:] != junction[:-1]])[-1]  # the last junction may go on
            carried = [x[open_from:] for x in rows]
            yield _only_ways([x[:open_from] for x in rows], k)
        if carried is not None:
            yield _only_ways(carried, k)

    there = [F.col(f"c{i}").isNotNull().alias(f"c{i}") for i in _SLOTS]
    return forks.select("src", *there).mapInArrow(choose, "src long, dst long")


def _only_ways(rows: list[np.ndarray], k: int) -> pa.RecordBatch:
    there = np.stack([x.astype(bool) for x in rows[1:]], axis=1)
    one = there.sum(axis=1) == 1
    src, nt = rows[0][one].astype(_U), there[one].argmax(axis=1).astype(_U)
    word = src << _U(2) | nt
    back = revcomps(word, k + 1)
    _, of, times = np.unique(np.minimum(word, back), return_inverse=True, return_counts=True)
    kept = (times[of] == 2) | (word == back)
    dst = word & _U((1 << 2 * k) - 1)
    return pa.RecordBatch.from_arrays([pa.array(x[kept].astype(np.int64)) for x in (src, dst)], ["src", "dst"])
