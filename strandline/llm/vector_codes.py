"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, fitted by weighted Lloyd rounds.

Vectors become integers and are cut into equal parts. Equal parts at one position become one row with a weight, so a
vector that stands a million times costs a round as much as one. In each round the distinct parts look up their nearest
entry in the codebooks, which are of fixed size, and add up by entry inside their task before anything is shuffled.
At the end codes and errors are joined back to the vectors by their parts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, staged

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers beyond are held here, and so is an error beyond a long.
MOST = 1 << 62
LONGEST = (1 << 63) - 1
#: Components of vectors, or distances, that a task holds at once; up to here doubles are exact.
HELD, EXACT = 4_000_000, 1 << 53


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles; scaling by a power of two is exact."""
    with np.errstate(over="ignore"):
        low = np.floor(x * SCALE)
    out = np.clip(low, -float(MOST), float(MOST)).astype("i8")
    return out


def pack(part: np.ndarray) -> bytes:
    """A part's integers, each in as few of 2, 4 or 8 bytes as all of them fit into; equal parts give equal bytes."""
    most = int(np.abs(part).max()) if len(part) else 0
    return part.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpack(data: list[bytes], size: int) -> np.ndarray:
    """Packed parts of `size` integers each as rows."""
    out = np.zeros((len(data), size), dtype="i8")
    lengths = np.fromiter(map(len, data), dtype="i8", count=len(data))
    for wide in (2, 4, 8) if size else ():
        at = np.flatnonzero(lengths == wide * size)
        if len(at):
            out[at] = np.frombuffer(b"".join(data[i] for i in at), dtype=f"<i{wide}").reshape(len(at), size)
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Index of each part's nearest entry, the lowest of equally near ones, and the squared distance, exactly."""
    most = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    if parts.shape[1] * (2 * most) ** 2 < EXACT:
        p, b = parts.astype("f8"), book.astype("f8")
        away = (b * b).sum(axis=1)[None, :] - 2 * (p @ b.T)
        code = away.argmin(axis=1)
        return code, (away[np.arange(len(p)), code] + (p * p).sum(axis=1)).astype("i8")
    codes, errors = np.zeros(len(parts), dtype="i8"), np.zeros(len(parts), dtype=object)
    entries = book.astype(object)
    for i, part in enumerate(parts.astype(object)):
        errors[i], codes[i] = min((int(((part - e) ** 2).sum()), n) for n, e in enumerate(entries))
    return codes, errors


def _keyed(width: int) -> object:
    """Batches of uid, vec_id, label and vector to those whose vector counts, with the keys of its parts."""
    size = width // PARTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, HELD // max(width, 1))
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                lists = some.column("vector").cast(pa.list_(pa.float64()))
                n = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                x = lists.flatten().to_numpy(zero_copy_only=False)  # null components are NaN here
                row = np.repeat(np.arange(len(n)), np.maximum(n, 0))
                odd = np.bincount(row, weights=~np.isfinite(x), minlength=len(n)) > 0
                grid = np.zeros((len(n), width), dtype="i8")
                ok = ~odd[row]
                column = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0), np.maximum(n, 0))
                grid[row[ok], column[ok]] = integers(x[ok])
                good = np.flatnonzero((n >= 0) & ~odd)
                kept = some.take(pa.array(good)).drop_columns(["vector"])
                keys = [[bytes([p]) + pack(grid[i, p * size : (p + 1) * size]) for p in range(PARTS)] for i in good]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(keys, type=pa.list_(pa.binary()))], names=[*kept.schema.names, "keys"])

    return cut


def _counts(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _starts(vectors: DataFrame, width: int) -> list[np.ndarray]:
    """The codebooks' first entries: parts of the vectors of the smallest ids; null ids come last, equal ids by vector."""
    first = vectors.where(_counts(F.col("vector"))).orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    grid = np.zeros((len(first), width), dtype="i8")
    for i, row in enumerate(first):
        grid[i, : len(row["vector"])] = integers(np.array(row["vector"], dtype="f8"))
    return [grid[:, p * width // PARTS : (p + 1) * width // PARTS] for p in range(PARTS)]


def _lookups(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Position, rows, integers, codes and errors of the parts in a batch, some at a time."""
    keys = batch.column("key").to_pylist()
    where = np.frombuffer(bytes(k[0] for k in keys), dtype="u1")
    for p, book in enumerate(books):
        mine = np.flatnonzero(where == p)
        step = max(1, HELD // max(len(book), book.shape[1], 1))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            parts = unpack([keys[i][1:] for i in rows], book.shape[1])
            yield p, rows, parts, *nearest(parts, book)


def _sums(books) -> object:
    """Batches of key and n to a row for each position and entry that a task has parts of: their number and sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            n = batch.column("n").to_numpy()
            for p, rows, parts, code, _ in _lookups(batch, books.value):
                weight = n[rows]
                small = float(np.abs(parts).max(initial=0)) * float(weight.sum()) < LONGEST
                parts = parts if small else parts.astype(object)
                order = np.argsort(code, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0]) if len(order) else []
                for c, w, s in zip(code[order][cuts], np.add.reduceat(weight[order], cuts), np.add.reduceat((parts * weight[:, None])[order], cuts), strict=True):
                    old = total.setdefault((p, int(c)), [0, [0] * parts.shape[1]])
                    old[0] += int(w)
                    old[1] = [a + int(b) for a, b in zip(old[1], s, strict=True)]
        rows = [(p, c, n, [Decimal(x) for x in s]) for (p, c), (n, s) in total.items()]
        columns = [[r[i] for r in rows] for i in range(4)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "n", "sums"])

    return add


def _moved(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each entry the floor of the mean of its parts; unused entries stay."""
    sent = parts.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries
    size = books[0].shape[1]
    each = parts.mapInArrow(_sums(sent), "part int, entry int, n long, sums array<decimal(38,0)>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).cast("array<string>").alias("sums"))
    books = [b.copy() for b in books]
    for row in total.collect():  # PARTS * ENTRIES rows at most
        books[row["part"]][row["entry"]] = [int(s) // row["n"] for s in row["sums"]]
    return books


def _coded(books) -> object:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(len(batch), dtype="i8"), np.zeros(len(batch), dtype="i8")
            for _, rows, _, c, e in _lookups(batch, books.value):
                codes[rows], errors[rows] = c, e if e.dtype != object else [min(x, LONGEST) for x in e]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(codes, type=pa.int32()), pa.array(errors)], names=["key", "entry", "away"])

    return code


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal integers by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error of each vector that counts; the final codebook of each part).

    Vectors that are null or have null or infinite components or NaN don't count and have no row. Vectors shorter than the
    longest, or than a multiple of PARTS, count as followed by zeros; empty ones as zeros. Rows that repeat an id stay rows
    of their own. Null ids come after all others where the smallest are sought; null labels are one label. With fewer
    vectors than entries the codebooks are shorter. Sums of errors beyond a long are held at the greatest one. Other
    columns, whatever their names, don't count. An empty table gives an empty result and empty codebooks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    longest = rows.agg(F.max(F.when(_counts(F.col("vector")), F.size("vector")))).first()[0] or 0
    width = math.ceil(longest / PARTS) * PARTS
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    keyed = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_keyed(width), f"vec_id {types['vec_id']}, label {types['label']}, uid long, keys array<binary>")

    parts = staged(keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "vector-parts")
    books = _starts(rows, width)
    for _ in range(rounds if len(books[0]) else 0):
        books = _moved(parts, books)

    # parts that stand in a large share of the vectors, fewer than HOT of them, are broadcast with their codes; the rows
    # of vectors that have them then need no partner, so they go anywhere
    sent, coded = spark.sparkContext.broadcast(books), "key binary, entry int, away long"
    total = parts.agg(F.sum("n")).first()[0] or 0
    hot = parts.where(F.col("n") * HOT > total).select("key").mapInArrow(_coded(sent), coded)
    cold = parts.where(F.col("n") * HOT <= total).select("key").mapInArrow(_coded(sent), coded)
    # one of a vector's rows carries its id and label
    own = [F.when(F.col("part") == 0, F.col(c)).alias(c) for c in ("vec_id", "label")]
    each = keyed.select("uid", "vec_id", "label", F.posexplode("keys").alias("part", "key")).select("uid", "part", "key", *own)
    each = each.join(F.broadcast(hot.withColumnsRenamed({"entry": "hot_entry", "away": "hot_away"})), "key", "left")
    alone = F.concat(F.lit("-").cast("binary"), F.encode(F.concat_ws("-", "uid", "part"), "utf-8"))  # no part begins with this byte
    each = each.withColumn("key", F.when(F.col("hot_entry").isNull(), F.col("key")).otherwise(alone)).join(cold, "key", "left")
    each = each.select("uid", "vec_id", "label", "part", F.coalesce("hot_entry", "entry").alias("entry"), F.coalesce("hot_away", "away").alias("away"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    held = lambda total: F.least(total, F.lit(LONGEST)).cast("long")
    found = each.groupBy("uid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), code.alias("code"), held(F.sum(F.col("away").cast("decimal(38,0)"))).alias("error"))
    found = staged(found.drop("uid"), "vector-codes")
    return _with_label_errors(found, held), books


def _with_label_errors(found: DataFrame, held) -> DataFrame:
    """found with label_error: the sum of error over its label. Labels with a large share of the rows are broadcast."""
    sums = staged(found.groupBy("label").agg(F.count("*").alias("n"), held(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "label-errors")
    total = found.count()
    hot = F.broadcast(sums.where((F.col("n") * HOT > total) | F.col("label").isNull()).select(F.col("label").alias("_label"), F.col("label_error").alias("hot_error")))
    rest = sums.where((F.col("n") * HOT <= total) & F.col("label").isNotNull()).select(F.col("label").alias("_rare"), "label_error")
    rows = found.join(hot, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    # rows whose label was broadcast meet nothing here, so a number of their own deals them out
    salt = F.when(F.col("hot_error").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    rows = rows.withColumn("salt", salt).join(rest.withColumn("zero", F.lit(0).cast("long")), (F.col("label") == F.col("_rare")) & (F.col("salt") == F.col("zero")), "left")
    return rows.select("vec_id", "label", "code", "error", F.coalesce("hot_error", "label_error").alias("label_error"))


def encode(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector; for odd rows see `compress`."""
    found, books = compress(vectors, vector, vec_id, label, rounds)
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
