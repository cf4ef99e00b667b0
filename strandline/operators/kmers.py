"""K-mers of reads: enumeration, counts, adapters, histograms and what they say about the genome."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.packing import MOST_PACKED, ORDER, Packing
from ..functions.staging import staged

#: Windows that are cut at once; k-mers (longs or short strings) that may be broadcast to choose among others.
WINDOWS_AT_ONCE, MOST_CHOSEN = 1 << 19, 2_000_000
# Runs of windows that share a word: the word's length, buckets in a partition, windows of a run and k-mers counted at once.
WORD, BUCKETS, LONGEST_RUN, COUNTED_AT_ONCE = 11, 16, 255, 1 << 20
_CODE, _BASES = np.full(256, 4, dtype=np.uint8), np.frombuffer(ORDER.encode(), dtype=np.uint8)
for _digit, _letters in enumerate(("Aa", "Cc", "Tt", "Gg")):
    _CODE[[ord(x) for x in _letters]] = _digit


def _packed_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of k codes and its reverse complement as numbers, put together from windows of 1, 2, 4, ... codes."""
    ahead, back, width = codes.astype(np.int64), (codes ^ 2).astype(np.int64), 1
    whole, turned, done = None, None, 0
    while True:
        if k & width:
            if done == 0:
                whole, turned = ahead, back
            else:  # what is done stands before this part
                n = len(codes) - done - width + 1
                whole = whole[:n] << 2 * width | ahead[done : done + n]
                turned = back[done : done + n] << 2 * done | turned[:n]
            done += width
        if done == k:
            return whole, turned
        n = len(codes) - 2 * width + 1
        ahead, back = ahead[:n] << 2 * width | ahead[width : width + n], back[width : width + n] << 2 * width | back[:n]
        width *= 2


def _digit_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as strings of digits, for any k."""
    view = np.lib.stride_tricks.sliding_window_view
    ahead = np.ascontiguousarray(view(codes + 48, k))
    back = np.ascontiguousarray(view((codes ^ 2)[::-1] + 48, k)[::-1])
    return ahead.view(f"S{k}").ravel(), back.view(f"S{k}").ravel()


def _strings(kmers: np.ndarray, k: int) -> pa.Array:
    offsets = np.arange(len(kmers) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(kmers), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kmers)))


def cut_windows(seqs: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sequence, place, canonical k-mer, whether it stands as it is) of the windows, in parts of bounded size."""
    seqs = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = seqs.buffers()[2]
    if data is None or not len(seqs):
        return
    letters = np.frombuffer(data, dtype=np.uint8)
    for a in range(int(offsets[0]), int(offsets[-1]) - k + 1, WINDOWS_AT_ONCE):
        codes = _CODE[letters[a : min(a + WINDOWS_AT_ONCE + k - 1, int(offsets[-1]))]]
        n = len(codes) - k + 1
        owner = np.searchsorted(offsets, np.arange(a, a + n), side="right") - 1
        bad = np.cumsum(np.r_[0, codes > 3])
        good = (bad[k:] == bad[:-k]) & (np.arange(a, a + n) + k <= offsets[owner + 1])
        ahead, back = (_packed_windows if k <= MOST_PACKED else _digit_windows)(codes & 3, k)
        plus = ahead < back
        at = np.flatnonzero(good)
        yield owner[at], a + at - offsets[owner[at]], np.where(plus, ahead, back)[at], plus[at]


def spread_hash(x: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each number."""
    return ((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _least_words(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the word of WORD codes, the same for its reverse complement, that is the least of a window of k codes."""
    m = min(WORD, k)
    ahead, back = _packed_windows(codes, m)
    low, width, words = np.minimum(ahead, back).astype(np.uint32) * np.uint32(2654435769), 1, k - m + 1
    while width < words:
        by = min(width, words - width)
        low, width = np.minimum(low[:-by], low[by:]), width + by
    return low


def _cut_runs(seqs: pa.Array, k: int, buckets: int, ids: pa.Array | None = None) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(buckets, [windows of each run, its bases four to a byte]): the windows of sequences as runs, those of a bucket together.

    A k-mer and its reverse complement have the same least word, and so one bucket, which overlapping windows often share;
    a run of n windows takes n + k - 1 bases. ids: longs of the sequences, for two more columns of a run: its sequence's
    id and its place in it, less than 0 (for place 0: -1) where the id is null.
    """
    named = None if ids is None else (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
    seqs = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = seqs.buffers()[2]
    if data is None or not len(seqs):
        return
    letters = np.frombuffer(data, dtype=np.uint8)
    for a in range(int(offsets[0]), int(offsets[-1]) - k + 1, WINDOWS_AT_ONCE):
        codes = _CODE[letters[a : min(a + WINDOWS_AT_ONCE + k - 1, int(offsets[-1]))]]
        n = len(codes) - k + 1
        bad = np.cumsum(np.r_[0, codes > 3], dtype=np.int32)
        good = bad[k:] == bad[:-k]
        for begin in offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, a + n + k - 1)]:  # none goes across
            good[max(begin - a - k + 1, 0) : max(begin - a, 0)] = False
        crossed = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + n)] - a
        codes &= 3
        bucket = spread_hash(_least_words(codes, k).astype(np.uint64), buckets)
        bucket[~good] = -1
        begins = np.r_[True, bucket[1:] != bucket[:-1]]
        begins[::LONGEST_RUN] = begins[crossed] = True
        starts = np.flatnonzero(begins)
        lengths, of = np.diff(np.r_[starts, n]), bucket[starts]
        order = np.argsort(of, kind="stable")[np.count_nonzero(of < 0) :]
        if not len(order):
            continue
        starts, lengths, of = starts[order], lengths[order], of[order]
        quads = (lengths + k + 2) // 4
        ends = quads.cumsum()
        at = np.repeat(starts - 4 * (ends - quads), quads) + 4 * np.arange(ends[-1])
        codes = np.r_[codes, np.zeros(4, dtype=np.uint8)]
        packed = codes[at] << 6 | codes[at + 1] << 4 | codes[at + 2] << 2 | codes[at + 3]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        cut = np.r_[first, len(of)]
        columns = [(cut, lengths.astype(np.uint8)), (np.r_[(ends - quads)[first], ends[-1]], packed)]
        if named:
            owner = np.searchsorted(offsets, a + starts, side="right") - 1
            at = a + starts - offsets[owner]
            ids = named[0][owner]
            steps = np.r_[ids[:1], np.diff(ids)]  # small ones, but for a bucket's first
            steps[first] = ids[first]
            columns += [(8 * cut, steps), (4 * cut, np.where(named[1][owner], -at - 1, at).astype(np.int32))]
        yield of[first], [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(c.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for c, x in columns]


def revcomps(kmers: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers."""
    if not k:
        return kmers
    x = kmers ^ np.uint64(sum(2 << 2 * i for i in range(k)))  # it is two away
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = x >> np.uint64(bits) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(bits)
    return x.byteswap() >> np.uint64(64 - 2 * k)


def _read_runs(lengths: np.ndarray, packed: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers of runs, each doubled, and one more if it stands as it is."""
    lengths = lengths.astype(np.int64)
    quads = (lengths + k + 2) // 4
    at = np.repeat(4 * (quads.cumsum() - quads) - (lengths.cumsum() - lengths), lengths) + np.arange(lengths.sum())
    byte, shift = at >> 2, (2 * (at & 3)).astype(np.uint64)
    packed = np.r_[packed, np.zeros(9, dtype=np.uint8)]
    ahead = np.ndarray(len(packed) - 8, ">u8", packed, strides=(1,))[byte].astype(np.uint64) << shift
    if k > 29:
        ahead |= packed[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift)
    ahead >>= np.uint64(64 - 2 * k)
    back = revcomps(ahead, k)
    return np.minimum(ahead, back) << np.uint64(1) | (ahead < back)


def _tally(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers in their order, counts, plus) of several such."""
    if len(parts) == 1:
        return parts[0]
    kmers, cnt, plus = map(np.concatenate, zip(*parts, strict=True))
    order = np.argsort(kmers, kind="stable")
    kmers = kmers[order]
    first = np.flatnonzero(np.r_[True, kmers[1:] != kmers[:-1]])
    return kmers[first], np.add.reduceat(cnt[order], first), np.add.reduceat(plus[order], first)


def _count_runs(rows: list[tuple[memoryview, memoryview]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mers in their order, counts, plus) of the runs of a bucket, counted in parts, so that memory goes by the distinct ones."""
    parts, held, n = [], [], 0
    for i, (lengths, packed) in enumerate(rows):
        held.append((np.frombuffer(lengths, np.uint8), np.frombuffer(packed, np.uint8)))
        n += len(lengths)
        if 6 * n < COUNTED_AT_ONCE and i < len(rows) - 1:
            continue
        keys = np.sort(_read_runs(*map(np.concatenate, zip(*held, strict=True)), k))
        kmers = keys >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, kmers[1:] != kmers[:-1]])
        parts.append((kmers[first].astype(np.int64), np.diff(np.r_[first, len(keys)]), np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)))
        if len(parts) > 1 and (sum(len(p[0]) for p in parts[1:]) > len(parts[0][0])):
            parts = [_tally(parts)]
        held, n = [], 0
    return _tally(parts)


def by_bucket(rows: DataFrame, n: int) -> DataFrame:
    """rows with the buckets of a partition together."""
    return rows.repartitionById(n, F.floor(F.col("bucket") / BUCKETS).cast("int"))


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The rows of each bucket of a partition, without the bucket."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append(row)
    for bucket in list(held):
        yield held.pop(bucket)


def _count_packed(reads: DataFrame, k: int, min_count: int) -> DataFrame:
    """kmer, cnt, plus by runs: overlapping windows go through the shuffle together, at little more than a byte a window."""
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, columns in _cut_runs(batch.column("seq"), k, n * BUCKETS):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], ["bucket", "lengths", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            found = _count_runs(rows, k)
            kept = found[1] >= min_count
            rows = pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in found], ["kmer", "cnt", "plus"])
            for a in range(0, len(rows), COUNTED_AT_ONCE):
                yield rows.slice(a, COUNTED_AT_ONCE)

    runs = reads.where(F.length("seq") >= k).select("seq").mapInArrow(cut, "bucket int, lengths binary, packed binary")
    return by_bucket(runs, n).mapInArrow(count, "kmer long, cnt long, plus long")


def _joined(rows: list[list[bytes]]) -> Iterator[list[np.ndarray]]:
    """The columns of a bucket's rows (see _cut_runs) in parts of bounded size; ids as they are."""
    held, n = [], 0
    for i, (lengths, packed, steps, places) in enumerate(rows):
        held.append((np.frombuffer(lengths, np.uint8), np.frombuffer(packed, np.uint8), np.frombuffer(steps, np.int64).cumsum(), np.frombuffer(places, np.int32)))
        n += len(lengths)
        if 6 * n >= COUNTED_AT_ONCE or i == len(rows) - 1:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield [joined[0].astype(np.int64), *joined[1:]]
            held, n = [], 0


def frequent_pieces(reads: DataFrame, k: int, low_count: int) -> DataFrame:
    """read_id, start, n: places of reads (read_id: long) where n windows in a row have k-mers that all reads together have
    at least low_count times. A bucket's windows are counted, and looked up again, where they meet."""
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, columns in _cut_runs(batch.column("seq"), k, n * BUCKETS, batch.column("read_id")):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *columns], ["bucket", "lengths", "packed", "ids", "places"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            known, cnt, _ = _count_runs([r[:2] for r in rows], k)
            known = known[cnt >= low_count].astype(np.uint64)
            for lengths, packed, ids, places in _joined(rows) if len(known) else ():
                each = _read_runs(lengths, packed, k) >> np.uint64(1)
                good = known[np.minimum(np.searchsorted(known, each), len(known) - 1)] == each
                begins = np.zeros(len(each) + 1, bool)
                begins[np.r_[0, lengths.cumsum()]] = True
                before, after = np.r_[False, good[:-1]] & ~begins[:-1], np.r_[good[1:], False] & ~begins[1:]
                first, last = np.flatnonzero(good & ~before), np.flatnonzero(good & ~after)
                run = np.searchsorted(lengths.cumsum(), first, side="right")
                null = places[run] < 0
                start = np.where(null, -places[run] - 1, places[run]) + first - (lengths.cumsum() - lengths)[run]
                yield pa.RecordBatch.from_arrays([pa.array(ids[run], mask=null), pa.array(start.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["read_id", "start", "n"])

    runs = reads.where(F.length("seq") >= k).select("read_id", "seq").mapInArrow(cut, "bucket int, lengths binary, packed binary, ids binary, places binary")
    return by_bucket(runs, n).mapInArrow(find, "read_id long, start int, n int")


def _letters(kmers: pa.Array, k: int) -> pa.Array:
    x = kmers.fill_null(0).to_numpy(zero_copy_only=False)
    letters = np.empty((len(x), k), dtype=np.uint8)
    for i in range(k):
        letters[:, i] = _BASES[x >> 2 * (k - 1 - i) & 3]
    found = _strings(letters, k)
    return pc.if_else(kmers.is_valid(), found, None) if kmers.null_count else found


def _column(kmers: np.ndarray, k: int) -> pa.Array:
    return pa.array(kmers) if k <= MOST_PACKED else _strings(kmers, k)


def explode_kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """The columns `keep`, pos (from 0), kmer (canonical, packed as Packing has it) and is_plus of each window of k bases.

    Shorter and null sequences have none, and windows with letters other than ACGT are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(list(keep))
            for owner, pos, kmer, plus in cut_windows(batch.column("seq"), k):
                columns = rest.take(pa.array(owner)).columns if keep else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pos.astype(np.int32)), _column(kmer, k), pa.array(plus)], [*keep, "pos", "kmer", "is_plus"])

    kept = [f"`{c}` {t}" for c, t in reads.select(*keep).dtypes] if keep else []
    schema = ", ".join([*kept, "pos int", f"kmer {Packing(k).type}", "is_plus boolean"])
    return reads.where(F.length("seq") >= k).select(*keep, "seq").mapInArrow(cut, schema)


def among(rows: DataFrame, known: DataFrame, most: int = MOST_CHOSEN) -> DataFrame:
    """rows whose kmer is one of known (read twice): where rows are, while there are at most `most` of them, else shuffled."""
    known = known.select("kmer").distinct()
    few = known.limit(most + 1).count() <= most
    return rows.join(F.broadcast(known) if few else known, "kmer", "left_semi")


def count_kmers(reads: DataFrame, k: int, min_count: int = 1, only: DataFrame | None = None) -> DataFrame:
    """kmer, cnt, plus (how many stand on the plus strand) of the canonical k-mers with at least min_count.

    only: rows with the k-mers that are counted; the others go before any shuffle.
    """
    if only is None and k <= MOST_PACKED and not reads.isStreaming:
        return _count_packed(reads, k, min_count)
    each = explode_kmers(reads, k)
    if only is not None:
        each = among(each, only)
    counts = each.groupBy("kmer").agg(F.count("*").alias("cnt"), F.sum(F.col("is_plus").cast("long")).alias("plus"))
    return counts.where(F.col("cnt") >= min_count) if min_count > 1 else counts


def lettered(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """rows with packed k-mers as letters."""
    columns = columns or ("kmer",)
    if k > MOST_PACKED:
        return rows.withColumns({c: Packing(k).text(F.col(c)) for c in columns})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_letters(x, k) if c in columns else x for c, x in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return rows.mapInArrow(write, StructType([StructField(f.name, StringType() if f.name in columns else f.dataType) for f in rows.schema]))


def histogram(kmers: DataFrame) -> DataFrame:
    """count, freq."""
    return kmers.groupBy(F.col("cnt").alias("count")).agg(F.count("*").alias("freq"))


def strand_fraction(kmers: DataFrame) -> DataFrame:
    """plus_q added: the plus fraction in steps of 1/65535, rounded, as graph filters use it."""
    return kmers.withColumn("plus_q", F.floor(F.col("plus") / F.col("cnt") * 65535 + 0.5).cast("int"))


def adapter_kmers(reads: DataFrame, fraction: float, limit: int, k: int = 19) -> DataFrame:
    """kmer, cnt of the k-mers as frequent as an adapter: at least `limit` and more than `fraction` of the reads."""
    reads_n = reads.agg(F.count("*").alias("n")).select(F.floor(F.col("n") * fraction).alias("most"))
    counts = count_kmers(reads, k, limit).select("kmer", "cnt")
    return counts.crossJoin(F.broadcast(reads_n)).where("cnt > most").select("kmer", "cnt")  # one row


def clip_adapters(reads: DataFrame, fraction: float, limit: int, k: int = 19) -> DataFrame:
    """reads (read_id, seq) cut where the first adapter k-mer begins; reads that begin with one are left out."""
    hits = among(explode_kmers(reads, k, "read_id"), staged(adapter_kmers(reads, fraction, limit, k), "adapters"))
    first = hits.groupBy("read_id").agg(F.min("pos").alias("_cut"))
    cut = reads.join(first, "read_id", "left")
    return cut.withColumn("seq", F.when(F.col("_cut").isNull(), F.col("seq")).otherwise(F.substr("seq", F.lit(1), F.col("_cut")))).where("seq <> ''").drop("_cut")


# What a histogram says; it has one row for each count, so it is small. Bins go by their place, not their count.

# Bins to either side that a peak stands above, how deep a valley is beside what lies behind it, the least
# frequency of a bin that counts for the volume, and the part of that volume at which the last range ends.
SLOPE, DEEP, LEAST_FREQ, VOLUME = 5, 0.7, 100, 0.8


def valleys(freq: np.ndarray) -> dict[int, int]:
    """The valley before each peak, -1 where it has none. Errors of reading are k-mers of low counts, falling towards the
    valley; the genome's are the peak behind it.

    A peak is higher than SLOPE bins to either side, which noise seldom is. Its valley is the lowest bin up to it, the
    first of equal ones, if that is clearly lower than the highest bin from there on.
    """
    if len(freq) < 2 * SLOPE + 1:
        return {}
    around = np.lib.stride_tricks.sliding_window_view(freq, 2 * SLOPE + 1)
    peaks = SLOPE + np.flatnonzero((around < around[:, [SLOPE]]).sum(axis=1) == 2 * SLOPE)
    lowest = {int(peak): int(freq[: peak + 1].argmin()) for peak in peaks}
    return {peak: low if low < peak and freq[low] < DEEP * freq[low:].max() else -1 for peak, low in lowest.items()}


def candidate_ranges(bins: list[tuple[int, int]]) -> pd.DataFrame:
    """valley (-1: none), last, size (k-mers from the valley on, 0 without one), volume (their counts) of each range that
    may be the genome's, as rows, the last range first.

    The first ends a bin behind the one with which VOLUME of the volume of frequent bins is exceeded: what is behind are
    repeats. Each further range ends at the valley of the one before, as a mixture has a peak for each of its parts. A
    range's valley is that of the last peak up to its end; where that peak has none there is no further range.
    """
    count, freq = np.array(bins, dtype="i8").reshape(-1, 2).T
    volume, before = count * freq, valleys(freq)
    enough = VOLUME * volume[freq >= LEAST_FREQ].sum()
    last, rows = int(min(np.searchsorted(volume.cumsum(), enough, side="right") + 1, len(bins) - 1)), []
    while not rows or rows[-1][0] >= 0:
        valley = before[max(p for p in before if p <= last)] if any(p <= last for p in before) else -1
        span = slice(max(valley, 0), last + 1)
        rows.append((valley, last, int(freq[span].sum()) if valley >= 0 else 0, int(volume[span].sum())))
        last = valley
    return pd.DataFrame(rows, columns=["valley", "last", "size", "volume"])


def main_range(bins: list[tuple[int, int]]) -> tuple[int, int]:
    """(valley or -1, last place) of the range that holds the genome: of the candidates in turn, the last that has more
    k-mers or more volume than the one chosen before it."""
    chosen = (-1, None, 0, 0)
    for row in candidate_ranges(bins).itertuples(index=False, name=None):
        if chosen[1] is None or row[2] > chosen[2] or row[3] > chosen[3]:
            chosen = row
    return int(chosen[0]), int(chosen[1])


def genome(hist: DataFrame) -> DataFrame:
    """valley, last (places in the histogram), genome_size and average_count as one row."""
    bins = [(r["count"], r["freq"]) for r in hist.orderBy("count").collect()]  # one row a count
    valley, last = main_range(bins) if bins else (-1, -1)
    span = bins[max(valley, 0) : last + 1]
    size = sum(f for _, f in span)
    row = (valley, last, size, sum(c * f for c, f in span) / size if size else 0.0)
    return hist.sparkSession.createDataFrame([row], "valley int, last int, genome_size long, average_count double")


def thresholds(average_count: float, min_count: int) -> tuple[int, int]:
    """(min_count, max_kmer_count) raised to what the coverage allows."""
    return max(min_count, int(average_count / 50 + 0.5)), max(10, int(average_count / 10 + 0.5))
