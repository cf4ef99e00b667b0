"""Ranked lexical search by Fagin's threshold algorithm.

Documents become rows of the query terms that they hold. A task takes such rows block by block. For a block it has, for
each term, the documents that hold it sorted by impact, and a forward index of all impacts of a document. A query goes
down its terms' lists side by side: each document that comes into sight is scored whole through the forward index, and
the search stops as soon as the threshold, what a document out of sight could score at most, falls strictly below the
lowest score that is kept. The best of the blocks before stay, so later blocks stop early. The tasks' best rows are then
ranked together, first in groups of tasks, then over all.

Queries go in stated blocks of bounded bytes, so that what goes to every task is bounded, however many queries there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import cumulated
from .common import UPPER, staged

BEST = 20
#: Bytes of query texts that are searched for together; impacts in the forward index of a block; documents of a block.
MOST_BYTES, HELD, MOST_DOCUMENTS = 1 << 20, 8_000_000, 4096
#: Places of each list that a query goes down at first; each next step is twice as long.
STEP = 16
#: Bytes that are not part of terms become spaces, A-Z become a-z.
_TABLE = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if chr(b) in UPPER else b for b in range(256))
_NO_ID = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms each."""
    if int(n.max(initial=0)) * 25 * n_docs >= 1 << 62:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], dtype="i8")
    return 75 + 25 * n.astype("i8") * n_docs // n_terms


def rates(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by: (1000000000 * tf) div (1000 * tf + 12 * m)."""
    return 1_000_000_000 * tf.astype("i8") // (1000 * tf.astype("i8") + 12 * m)


class Block:
    """Documents with their impacts by term, and each term's list of documents by falling impact."""

    def __init__(self, documents: np.ndarray, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.documents = documents  # ids
        self.forward = np.zeros((len(documents), n_terms), dtype="i8")
        self.forward[document, term] = impact
        order = np.lexsort((-impact, term))
        self.listed, self.impact = document[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))


def search(block: Block, query: np.ndarray, times: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best documents of the block and of `best`, which are those before; score above 0 only.

    query: distinct terms; times: how often the query has each. Documents are equal in rank only if score and id are.
    """
    scores, ids = best
    start, end = block.start[query], block.start[query + 1]
    seen = np.zeros(len(block.documents), dtype=bool)
    at, step = 0, STEP
    while True:
        alive = start + at < end
        if not alive.any():
            return scores, ids
        if len(scores) == k:  # what a document out of sight can score at most
            first = np.minimum(start + at, len(block.impact) - 1)
            if int((np.where(alive, block.impact[first], 0) * times).sum()) < scores[-1]:
                return scores, ids
        found = np.concatenate([block.listed[s + at : min(s + at + step, e)] for s, e in zip(start[alive], end[alive], strict=True)])
        found = np.unique(found[~seen[found]])
        seen[found] = True
        if len(found):
            got = block.forward[np.ix_(found, query)] @ times
            scores, ids = np.concatenate([scores, got]), np.concatenate([ids, block.documents[found]])
            if len(scores) > k:
                few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                order = few[np.lexsort((ids[few], -scores[few]))][:k]
            else:
                order = np.lexsort((ids, -scores))
            scores, ids = scores[order], ids[order]
            while len(scores) and scores[-1] <= 0:
                scores, ids = scores[:-1], ids[:-1]
        at, step = at + step, 2 * step


def _held_terms(vocabulary) -> object:
    """Batches of doc_id and text to doc_id, n (terms) and the numbers and counts of the query terms held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            n, held, times = [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                which, tf = np.unique(np.fromiter(map(number.get, found, repeat(-1)), dtype="i4", count=len(found)), return_counts=True)
                known = which >= 0
                n.append(len(found))
                held.append(which[known].astype("<i4").tobytes())
                times.append(tf[known].astype("<i4").tobytes())
            columns = [batch.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(held, type=pa.binary()), pa.array(times, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "held", "times"])

    return count


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each term that a task has documents of, and their number."""
    total = np.zeros(0, dtype="i8")
    for batch in batches:
        held = np.frombuffer(b"".join(batch.column("held").to_pylist()), dtype="<i4")
        if len(held):
            n = np.bincount(held, minlength=len(total))
            n[: len(total)] += total
            total = n
    which = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(which, type=pa.int32()), pa.array(total[which])], names=["term", "df"])


def _best(given, k: int) -> object:
    """Batches of documents' terms to item, doc_id and score of the k best documents of the task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_terms = given.value
        best = [(np.empty(0, dtype="i8"), np.empty(0, dtype="i8"))] * len(queries)
        most = max(1, min(MOST_DOCUMENTS, HELD // max(len(weights), 1)))
        for batch in batches:
            for at in range(0, len(batch), most):
                some = batch.slice(at, most)
                held = some.column("held").to_pylist()
                size = np.fromiter(map(len, held), dtype="i8", count=len(held)) // 4
                document = np.repeat(np.arange(len(held)), size)
                if not len(document):
                    continue
                term, tf = (np.frombuffer(b"".join(x), dtype="<i4") for x in (held, some.column("times").to_pylist()))
                m = length_norm(some.column("n").to_numpy(), n_docs, n_terms)
                block = Block(some.column("doc_id").fill_null(_NO_ID).to_numpy(), document, term, weights[term] * rates(tf, m[document]), len(weights))
                for i, (query, times) in enumerate(queries):
                    best[i] = search(block, query, times, best[i], k)
        n = [len(scores) for scores, _ in best]
        ids = np.concatenate([ids for _, ids in best]) if best else np.empty(0, dtype="i8")
        scores = np.concatenate([s for s, _ in best]) if best else np.empty(0, dtype="i8")
        columns = [pa.array(np.repeat(np.arange(len(best)), n), type=pa.int32()), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items (item_id, text) of one block."""
    spark = docs.sparkSession
    counted = []
    number: dict[bytes, int] = {}
    for item in items:
        found = terms(item["text"])
        which, times = np.unique(np.fromiter((number.setdefault(t, len(number)) for t in found), dtype="i8", count=len(found)), return_counts=True)
        counted.append((which, times))
    held = staged(docs.mapInArrow(_held_terms(spark.sparkContext.broadcast(number)), "doc_id long, n long, held binary, times binary"), "search-terms")
    size = held.withColumn("task", F.spark_partition_id()).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.max("task").alias("last_task")).first()
    df = np.zeros(len(number), dtype="i8")
    for row in held.select("held").mapInArrow(_documents_with, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]  # one row a term of the block's queries
    weights = np.array([weight(size["docs"], int(x)) for x in df], dtype="i8")
    given = spark.sparkContext.broadcast((counted, weights, size["docs"], size["terms"]))
    best = held.where("n > 0").mapInArrow(_best(given, k), "item int, doc_id long, score long")
    # every task has k rows an item: they meet in groups of tasks first, so that no task gets them all
    groups = math.isqrt((size["last_task"] or 0) + 1)
    best = _ranked(best.withColumn("group", F.spark_partition_id() % groups), k, "item", "group").drop("rank", "group")
    best = _ranked(best, k, "item")
    named = spark.createDataFrame([(i, item["item_id"]) for i, item in enumerate(items)], f"item int, item_id {items[0].asDict()['kind']}")
    return best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_all(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, the best first.

    Terms are runs of letters, digits and all beyond ASCII, A-Z lower-cased; the score is that of the contract. Equal
    scores are ranked by ascending id, null ids last. Null and empty texts have no terms: such an item has no rows, such
    a document isn't counted. Rows that repeat an id are documents, or items, of their own, so a repeated item id has a
    list for each row. Texts are used whole, however long. Other columns, whatever their names, don't count. Empty tables
    give an empty result. Items are searched for in blocks of `most_bytes` of text (a longer text is one block), each
    over all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where(F.length("text") > 0)
    size = F.octet_length("text").cast("long")
    if (asked.agg(F.sum(size)).first()[0] or 0) <= most_bytes:
        blocks = [asked]
    else:
        asked = staged(cumulated(asked, {"up_to": size}, "item_id", "text").withColumn("block", F.floor(F.col("up_to") / most_bytes)), "search-items")
        blocks = [asked.where(F.col("block") == row["block"]) for row in asked.select("block").distinct().orderBy("block").collect()]
    found = []
    for block in blocks:
        few = block.select("item_id", "text", F.lit(kind).alias("kind")).collect()  # bounded by most_bytes
        if few:
            found.append(_search_block(rows, few, k))
    nothing = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else nothing
