"""Toxicity: a convolutional text classifier, trained in numpy on all labelled rows.

A word is the mean of the embeddings of its hashed pieces: itself, its beginnings and its endings, so that forms never
seen still resemble those seen. Filters of several widths run over the whole text, and of each the POOLED greatest values
count, rectified. The labelled rows are dealt into parts; in each round every part trains on from what the parts came to
together, and what they change is averaged. Beside the model of all rows there is one for each fold that never sees that
fold: their margins, one for each labelled row, give the logistic curve that makes margins scores, and the threshold at
which each language's own errors are balanced best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import drop
from .common import staged

#: Labelled rows and letters of a part, about; neighbouring buckets averaged together; words remembered by a worker.
PART_ROWS, PART_LETTERS, CHUNK, REMEMBERED = 16_000, 64_000_000, 1024, 60_000
#: Hashed pieces, their dimensions, filters of each width, widths in words (ascending), values kept of each filter.
BUCKETS, SIZE, FILTERS, WIDTHS, POOLED = 1 << 15, 16, 12, (1, 2, 3), 3
#: Letters of the beginnings and endings that are pieces of a word.
STARTS, ENDS = (3, 4, 5, 6, 7), (3, 4)
PIECES = 1 + len(STARTS) + len(ENDS)
ROUNDS, BATCH, RATE, DECAY = 5, 32, 0.02, 1e-4
#: Folds for the curve and the thresholds; margins are counted in steps of 1 / GRID up to WIDEST.
FOLDS, GRID, WIDEST = 2, 1024, 64
THRESHOLD = 0.3
#: Words that a filter runs over at once in a long text; positive rows that a language's own threshold needs.
STRIDE, LEAST_POSITIVE = 20_000, 20
_WORD = re.compile(r"\w+")


def pieces(words: list[str]) -> np.ndarray:
    """PIECES buckets a word: of the word, its beginnings and its endings; those that a short word lacks are the word again."""
    found = np.empty((len(words), PIECES), dtype="u2")
    found[:] = np.fromiter((xxhash.xxh64_intdigest(w) % BUCKETS for w in words), dtype="u2", count=len(words))[:, None]
    length, at = np.fromiter(map(len, words), dtype="i8", count=len(words)), 1
    for seed, sizes, parts in ((1, STARTS, [w[: STARTS[-1]] for w in words]), (2, ENDS, [w[: -ENDS[-1] - 1 : -1] for w in words])):
        letters = np.array(parts, dtype=f"U{sizes[-1]}").view("u4").reshape(len(words), sizes[-1])
        h = np.full(len(words), 0xCBF29CE484222325 + seed, dtype="u8")
        for n in range(1, sizes[-1] + 1):
            h = (h ^ letters[:, n - 1]) * np.uint64(0x100000001B3)
            if n in sizes:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                found[:, at] = np.where(length > n, mixed % np.uint64(BUCKETS), found[:, 0])
                at += 1
    return found


class _Vocabulary(dict):
    """Numbers of words; those whose pieces were not asked for yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), dtype="i4", count=len(found))

    def pieces(self) -> np.ndarray:
        """Of the words that came since the last call."""
        found, self.fresh = pieces(self.fresh), []
        return found


@dataclass
class Model:
    pieces: np.ndarray  # BUCKETS x SIZE
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # a weight for each filter and pooled value
    shift: float
    slope: float = 1.0
    moved: float = 0.0

    def words(self, words: np.ndarray) -> np.ndarray:
        """The embeddings of words given by their pieces."""
        found = np.zeros((len(words), SIZE), dtype="f4")
        for column in np.ascontiguousarray(words.T, dtype="i8"):
            found += self.pieces.take(column, axis=0)
        return found / np.float32(PIECES)

    def matrix(self) -> np.ndarray:
        """SIZE x what the filters add: all filters' first places, then the second places of those that have one, ..."""
        return np.concatenate([f[j] for j in range(WIDTHS[-1]) for f in self.filters if len(f) > j], axis=1)

    def projected(self, words: np.ndarray) -> np.ndarray:
        """What each filter adds at each of its places, its bias with the first, for words given by their pieces."""
        return self.added(self.words(words))

    def added(self, x: np.ndarray) -> np.ndarray:
        rows = x @ self.matrix()
        rows[:, : FILTERS * len(WIDTHS)] += np.concatenate(self.bias)
        return rows

    def pooled(self, rows: np.ndarray, places: bool = False, most: int | None = None):
        """The POOLED greatest values of each filter over words given by what filters add, falling; 0 where there are fewer.

        places: also at which word each stands, -1 where there is none. most: places that a filter is looked at, from the first.
        """
        n, width = min(len(rows), most or len(rows)), FILTERS * len(WIDTHS)
        kept, at = np.zeros((POOLED, width), dtype="f4"), np.full((POOLED, width), -1)
        if not n:
            return (kept, at) if places else kept
        each, column = np.ascontiguousarray(rows[: n + WIDTHS[-1] - 1].T), width
        value = np.ascontiguousarray(each[:width, :n])
        for j in range(1, WIDTHS[-1]):  # the text is followed by words that are zero
            wide = FILTERS * sum(w > j for w in WIDTHS)
            part = each[column : column + wide, j : n + j]
            value[width - wide :, : part.shape[1]] += part
            column += wide
        flat, every = value.ravel(), np.arange(width) * n
        for k in range(min(POOLED, n)):
            best = value.argmax(axis=1)
            there = every + best
            kept[k], at[k] = flat[there], best
            flat[there] = -np.inf
        at[kept <= 0] = -1
        np.maximum(kept, 0, out=kept)
        return (kept, at) if places else kept

    def margin(self, numbers: np.ndarray, rows: np.ndarray) -> float:
        """Of a text given by its words' numbers, rows being what filters add for each word; long texts go in strides."""
        if len(numbers) <= STRIDE:
            kept = self.pooled(rows.take(numbers, axis=0))
        else:
            # a stride's last places reach into the words of the next
            kept = np.concatenate([self.pooled(rows[numbers[at : at + STRIDE + max(WIDTHS) - 1]], most=STRIDE) for at in range(0, len(numbers), STRIDE)])
            kept = -np.sort(-kept, axis=0)[:POOLED]
        return float((kept * self.out).sum() + self.shift)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.moved, -30, 30)))


def _new(ratios: np.ndarray | None = None) -> Model:
    """Random weights; the first dimension of a piece begins as the log ratio of its counts, which all filters look for."""
    draw = np.random.default_rng(0)
    filters = [draw.normal(0, (1 / (w * SIZE)) ** 0.5, (w, SIZE, FILTERS)).astype("f4") for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.2
    start = draw.normal(0, 0.1, (BUCKETS, SIZE)).astype("f4")
    if ratios is not None:
        start[:, 0] = ratios
    out = np.abs(draw.normal(0, 0.1, (POOLED, FILTERS * len(WIDTHS)))).astype("f4")
    return Model(start, filters, [np.full(FILTERS, -0.2, dtype="f4") for _ in WIDTHS], out, 0.0)


def _counts(texts: list[np.ndarray], words: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """How many texts of label 0 and of label 1 hold a piece."""
    count = np.zeros((2, BUCKETS), dtype="i8")
    for text, b in zip(texts, bad, strict=True):
        held = np.zeros(BUCKETS, dtype=bool)
        held[words[text]] = True
        count[int(b)] += held
    return count


def _ratios(count: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Log ratio of the shares of texts of either label that hold a piece, one text more on each side; size: texts of either."""
    share = (count + 1) / np.array([[size[0] + 2], [size[1] + 2]])
    # a piece that few texts hold says little: with one more on each side it would lean to the smaller class
    seen = count.sum(axis=0)
    return np.where(seen > 0, np.log(share[1] / share[0]) * seen / (seen + 3), 0).astype("f4")


class _State:
    """A model in training. Adagrad: each weight moves by its gradient over the root of all its squares so far.

    The dimensions of a piece share the mean of their squares. `dense` is all weights but those of the pieces.
    """

    def __init__(self, table: np.ndarray, dense: np.ndarray, squares: np.ndarray | None = None, dense_squares: np.ndarray | None = None):
        self.table, self.dense = table, dense
        self.squares = np.full(len(table), 1e-4, dtype="f4") if squares is None else squares
        self.dense_squares = np.full(len(dense), 1e-4, dtype="f4") if dense_squares is None else dense_squares

    @staticmethod
    def of(model: Model) -> _State:
        return _State(model.pieces, np.concatenate([x.ravel() for x in (*model.filters, *model.bias, model.out, np.float32([model.shift]))]))

    def copy(self) -> _State:
        return _State(self.table.copy(), self.dense.copy(), self.squares.copy(), self.dense_squares.copy())

    def model(self) -> Model:
        """Its arrays are views, so that it moves with every step, but for the shift."""
        shapes = [*((w, SIZE, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (POOLED, FILTERS * len(WIDTHS))]
        parts = np.split(self.dense[:-1], np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
        parts = [x.reshape(shape) for x, shape in zip(parts, shapes, strict=True)]
        return Model(self.table, parts[: len(WIDTHS)], parts[len(WIDTHS) : -1], parts[-1], float(self.dense[-1]))

    def step(self, bucket: np.ndarray, gradient: np.ndarray, dense: np.ndarray) -> None:
        self.squares[bucket] += (gradient * gradient).mean(axis=1)
        self.table[bucket] -= RATE * (gradient / np.sqrt(self.squares[bucket])[:, None] + DECAY * self.table[bucket])
        self.dense_squares += dense * dense
        self.dense -= RATE * (dense / np.sqrt(self.dense_squares) + DECAY * self.dense)


def _round(state: _State, texts: list[np.ndarray], words: np.ndarray, bad: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
    """Steps on the logistic loss over texts in an order. Gradients pass only through the words that were the greatest."""
    model, width = state.model(), FILTERS * len(WIDTHS)
    columns = FILTERS * sum(WIDTHS)
    first_column = np.cumsum([0, *(FILTERS * sum(w > j for w in WIDTHS) for j in range(WIDTHS[-1]))])
    for begin in range(0, len(order), BATCH):
        some = order[begin : begin + BATCH]
        used, mine = np.unique(np.concatenate([texts[i] for i in some]), return_inverse=True)
        size = np.array([len(texts[i]) for i in some])
        end, matrix = np.cumsum(size), model.matrix()
        x = model.words(words[used])
        rows = model.added(x)
        kept, at = zip(*(model.pooled(rows.take(mine[e - n : e], axis=0), True) for n, e in zip(size, end, strict=True)), strict=True)
        kept, at = np.stack(kept), np.stack(at)
        margin = (kept * model.out).sum(axis=(1, 2)) + state.dense[-1]
        g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - bad[some]) * weight[some] / len(some)).astype("f4")
        text, k, filter_ = np.nonzero(at >= 0)
        first, slope = at[text, k, filter_] + (end - size)[text], g[text] * model.out[k, filter_]
        word, column, value = [], [], []
        for j in range(WIDTHS[-1]):
            own = np.flatnonzero((filter_ >= width - (first_column[j + 1] - first_column[j])) & (first + j < end[text]))
            word.append(mine[first[own] + j])
            column.append(filter_[own] - width + first_column[j + 1])
            value.append(slope[own])
        moved, place = np.unique(np.concatenate(word), return_inverse=True)
        added = np.bincount(place * columns + np.concatenate(column), np.concatenate(value), len(moved) * columns).reshape(-1, columns).astype("f4")
        dx, by_column = added @ matrix.T / PIECES, x[moved].T @ added
        bucket, back = np.unique(words[used[moved]].ravel(), return_inverse=True)
        flat = np.bincount((back[:, None] * SIZE + np.arange(SIZE)).ravel(), np.repeat(dx, PIECES, axis=0).ravel(), len(bucket) * SIZE)
        filters = [np.zeros((w, SIZE, FILTERS), dtype="f4") for w in WIDTHS]
        for j in range(WIDTHS[-1]):
            for n, f in enumerate(f for f in filters if len(f) > j):
                f[j] = by_column[:, first_column[j] + n * FILTERS :][:, :FILTERS]
        dense = [*(f.ravel() for f in filters), np.bincount(filter_, slope, width), np.einsum("i,ikf->kf", g, kept).ravel(), [g.sum()]]
        state.step(bucket, flat.reshape(-1, SIZE).astype("f4"), np.concatenate(dense).astype("f4"))


def _train(texts: list[np.ndarray], words: np.ndarray, bad: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of rows that are all at hand."""
    state, draw = _State.of(_new(_ratios(_counts(texts, words, bad), (int((~bad).sum()), int(bad.sum()))))), np.random.default_rng(1)
    for _ in range(rounds):
        _round(state, texts, words, bad, weight, draw.permutation(len(texts)))
    return state.model()


def _curve(margins: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets; rows weigh what they stand for."""
    p, n = float((weight * bad).sum()), float((weight * ~bad).sum())
    goal = np.where(bad, (p + 1) / (p + 2), 1 / (n + 2))
    x, theta = np.c_[margins, np.ones(len(margins))], np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (q - goal)) + 1e-3 * (theta - [1.0, 0.0])
        theta = theta - np.clip(np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + 1e-3 * np.eye(2), grad), -1, 1)
    return max(float(theta[0]), 1e-3), float(theta[1])


def threshold_of(score: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between scores at which the F1 of these rows is greatest."""
    order = np.argsort(-score, kind="stable")
    score, hit, all_ = score[order], np.cumsum((weight * bad)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * bad).sum())
    f1[:-1][score[1:] == score[:-1]] = -1  # equal scores fall on one side
    at = int(f1.argmax())
    return float((score[at] + (score[at + 1] if at + 1 < len(score) else 0.0)) / 2)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _flat(bad: bool | None) -> Model:
    """Scores all texts alike: there are no labels, or all are `bad`."""
    flat = _new()
    flat.out[:] = 0
    flat.moved = 0.0 if bad is None else 3.0 if bad else -3.0
    return flat


@dataclass
class _Part:
    """The labelled rows of one part, their words as numbers."""

    part: int
    texts: list[np.ndarray]
    words: np.ndarray  # the pieces of each number
    bad: np.ndarray
    lang: list[str | None]

    SCHEMA = "part int, numbers binary, sizes binary, words binary, bad binary, lang array<string>"

    @staticmethod
    def packed(part: int, texts: pd.Series, bad: np.ndarray, lang: list[str | None]) -> pd.DataFrame:
        vocabulary, pack = _Vocabulary(), zstandard.ZstdCompressor(3).compress
        numbers = [vocabulary.numbers(t) for t in texts]
        sizes = np.array([len(x) for x in numbers], dtype="<i8")
        row = [part, pack(np.concatenate(numbers).astype("<i4").tobytes()), sizes.tobytes(), pack(vocabulary.pieces().astype("<u2").tobytes()), bad.tobytes(), lang]
        return pd.DataFrame([row], columns=["part", "numbers", "sizes", "words", "bad", "lang"])

    @staticmethod
    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[_Part]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.itertuples():
                numbers, sizes = np.frombuffer(unpack(row.numbers), dtype="<i4"), np.frombuffer(row.sizes, dtype="<i8")
                words = np.frombuffer(unpack(row.words), dtype="<u2").reshape(-1, PIECES)
                yield _Part(row.part, np.split(numbers, np.cumsum(sizes)[:-1]), words, np.frombuffer(row.bad, dtype=bool), list(row.lang))

    def fold(self) -> np.ndarray:
        """Of each row, either class dealt in turn."""
        return np.where(self.bad, np.cumsum(self.bad), np.cumsum(~self.bad)) % FOLDS


def _labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, lang: str) -> tuple[DataFrame | None, int, int]:
    """All rows whose label isn't held out, one row a part, staged; how many rows have label 0 and label 1."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) == 1).alias("_bad"))
    spoken = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x"), spoken.alias("lang")).where(~is_held_out(F.col("id")))
    size = rows.select("id", F.length("x").alias("n")).join(known, F.col("id") == F.col("_id")).groupBy("id").agg(F.max("n").alias("n"), F.first("_bad").alias("bad"))
    size = size.agg(F.count("*").alias("all"), F.count_if("bad").alias("bad"), F.sum("n").alias("letters")).first()
    good, bad = size["all"] - size["bad"], size["bad"]
    if not good or not bad:
        return None, good, bad
    parts = max(-(-size["all"] // PART_ROWS), -(-size["letters"] // PART_LETTERS))
    # of rows that repeat a labelled id the one of the least hash counts
    rows = rows.join(known, F.col("id") == F.col("_id")).groupBy("id").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x", "lang", F.col("_bad").alias("bad"))).alias("row"))

    def packed(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("id")
        return _Part.packed(int(got["part"].iloc[0]), got["x"], got["bad"].to_numpy(dtype=bool), [x if isinstance(x, str) else None for x in got["lang"]])

    rows = rows.select("id", "row.x", "row.bad", "row.lang", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return staged(rows.repartition(parts, "part").groupBy("part").applyInPandas(packed, _Part.SCHEMA), "toxicity-parts"), good, bad


def _started(parts: DataFrame) -> list[_State]:
    """How models begin, for each fold one without its counts, then that of all rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _Part.unpacked(batches):
            fold = part.fold()
            for k in range(FOLDS):
                own = np.flatnonzero(fold == k)
                count = _counts([part.texts[i] for i in own], part.words, part.bad[own])
                seen = np.flatnonzero(count.any(axis=0))
                there = pd.DataFrame({"fold": k, "bucket": seen.astype("i4"), "good": count[0, seen], "bad": count[1, seen]})
                rows = pd.DataFrame({"fold": [k], "bucket": np.int32([BUCKETS]), "good": [int((~part.bad[own]).sum())], "bad": [int(part.bad[own].sum())]})
                yield pd.concat([there, rows])

    count = np.zeros((FOLDS, 2, BUCKETS + 1), dtype="i8")  # the last: rows
    for r in parts.mapInPandas(counted, "fold int, bucket int, good long, bad long").groupBy("fold", "bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        count[r["fold"], :, r["bucket"]] = r["good"], r["bad"]
    seen = [*(count.sum(axis=0) - own for own in count), count.sum(axis=0)]
    return [_State.of(_new(_ratios(c[:, :-1], tuple(c[:, -1])))) for c in seen]


def _moved(parts: DataFrame, states: list[_State], turn: int, balance: tuple[float, float]) -> list[_State]:
    """One round: each part trains on from the states, and the means of their changes are added.

    A piece's change is the mean over the parts that changed it, so that one which few parts hold isn't held back.
    """
    sent = parts.sparkSession.sparkContext.broadcast(states)  # of fixed size

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _Part.unpacked(batches):
            fold, weight = part.fold(), np.where(part.bad, balance[1], balance[0])
            for k, before in enumerate(sent.value):
                after, own = before.copy(), np.flatnonzero(fold != k)
                _round(after, part.texts, part.words, part.bad, weight, np.random.default_rng([turn, part.part]).permutation(own))
                table, squares = after.table - before.table, after.squares - before.squares
                chunk = np.flatnonzero(squares.reshape(-1, CHUNK).any(axis=1))
                some = [(c, table[c * CHUNK : (c + 1) * CHUNK], squares[c * CHUNK : (c + 1) * CHUNK]) for c in chunk.tolist()]
                some.append((BUCKETS // CHUNK, after.dense - before.dense, after.dense_squares - before.dense_squares))
                yield pd.DataFrame([(k, c, part.part, x.tobytes(), y.tobytes()) for c, x, y in some], columns=["k", "chunk", "part", "change", "squares"])

    def averaged(rows: pd.DataFrame) -> pd.DataFrame:
        change = squares = count = 0.0
        for row in rows.sort_values("part").itertuples():
            y = np.frombuffer(row.squares, dtype="f4")
            squares, count = squares + y.astype("f8"), count + (y > 0)
            change = change + np.frombuffer(row.change, dtype="f4").reshape(len(y), -1).astype("f8")
        count = np.maximum(count, 1)
        row = [rows["k"].iloc[0], rows["chunk"].iloc[0], (change / count[:, None]).astype("f4").tobytes(), (squares / count).astype("f4").tobytes()]
        return pd.DataFrame([row], columns=["k", "chunk", "change", "squares"])

    changes = parts.mapInPandas(trained, "k int, chunk int, part int, change binary, squares binary").groupBy("k", "chunk").applyInPandas(averaged, "k int, chunk int, change binary, squares binary")
    states = [s.copy() for s in states]
    for row in changes.collect():
        change, squares, state = np.frombuffer(row["change"], dtype="f4"), np.frombuffer(row["squares"], dtype="f4"), states[row["k"]]
        if row["chunk"] == BUCKETS // CHUNK:
            state.dense += change
            state.dense_squares += squares
        else:
            at = slice(row["chunk"] * CHUNK, (row["chunk"] + 1) * CHUNK)
            state.table[at] += change.reshape(-1, SIZE)
            state.squares[at] += squares
    sent.unpersist()
    return states


def _margins(parts: DataFrame, models: list[Model]) -> DataFrame:
    """lang, at (a margin times GRID), bad, n: all labelled rows counted by the margin that the model without their fold gives."""
    sent = parts.sparkSession.sparkContext.broadcast(models)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _Part.unpacked(batches):
            fold, at = part.fold(), np.zeros(len(part.bad), dtype="i4")
            for k, model in enumerate(sent.value):
                own = np.flatnonzero(fold == k)
                margins = np.array([model.margin(*_own_rows(model, part.texts[i], part.words)) for i in own])
                at[own] = np.rint(np.clip(margins, -WIDEST, WIDEST) * GRID)
            yield pd.DataFrame({"lang": part.lang, "at": at, "bad": part.bad})

    return parts.mapInPandas(found, "lang string, at int, bad boolean").groupBy("lang", "at", "bad").agg(F.count("*").alias("n"))


def _own_rows(model: Model, text: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, mine = np.unique(text, return_inverse=True)
    return mine, model.projected(words[used])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str = "lang") -> tuple[Model, DataFrame | None]:
    """A model of all labels that aren't held out, and lang, least: the threshold of each language with enough rows of both.

    The rows are trained on in parts, see `_moved`; what comes to the driver are models and counts by margin, both of
    fixed size. Counts, weights, curve and thresholds are all made of all these rows.
    """
    parts, good, bad = _labelled(docs, labels, text, doc_id, label, lang)
    if parts is None:
        return _flat(bool(bad) if good or bad else None), None
    balance = (0.5 * (good + bad) / good, 0.5 * (good + bad) / bad)
    states = _started(parts)
    for turn in range(ROUNDS):
        states = _moved(parts, states, turn, balance)
    models = [s.model() for s in states]
    counts, model = staged(_margins(parts, models[:FOLDS]), "toxicity-margins"), models[FOLDS]
    drop(parts)
    seen = np.array([(r["at"], r["bad"], r["n"]) for r in counts.groupBy("at", "bad").agg(F.sum("n").alias("n")).orderBy("at", "bad").collect()], dtype="f8")
    model.slope, model.moved = _curve(seen[:, 0] / GRID, seen[:, 1] == 1, seen[:, 2])
    slope, moved = model.slope, model.moved

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "bad"])
        bad, weight = rows["bad"].to_numpy(dtype=bool), rows["n"].to_numpy(dtype="f8")
        if weight[bad].sum() < LEAST_POSITIVE or bad.all():
            return pd.DataFrame({"lang": pd.Series(dtype="object"), "least": pd.Series(dtype="f8")})
        score = 1 / (1 + np.exp(-np.clip(slope * rows["at"].to_numpy() / GRID + moved, -30, 30)))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "least": [threshold_of(score, bad, weight)]})

    return model, staged(counts.where("lang is not null").groupBy("lang").applyInPandas(least, "lang string, least double"), "toxicity-thresholds")


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) added; only the text decides, whole, however long.

    Null texts score as empty ones. A column score is replaced, all others stay as they are, whatever their names; rows
    that repeat an id stay rows of their own; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, words, done = model.value, _Vocabulary(), 0
        rows = np.empty((1024, FILTERS * sum(WIDTHS)), dtype="f4")
        for texts in parts:
            margins = []
            for begin in range(0, len(texts), BATCH):
                if done > REMEMBERED:
                    words, done = _Vocabulary(), 0
                numbers = [words.numbers(t) for t in texts[begin : begin + BATCH]]
                if len(words) > len(rows):
                    rows = np.concatenate([rows, np.empty((max(len(rows), len(words) - len(rows)), rows.shape[1]), dtype="f4")])
                if len(words) > done:
                    rows[done : len(words)] = m.projected(words.pieces())
                    done = len(words)
                margins += [m.margin(n, rows) for n in numbers]
            yield pd.Series(m.score(np.array(margins, dtype="f8")), dtype="f8")

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    return docs.select(*kept, score_of.asNondeterministic()(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("score"))  # not called again for each use


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is 2 modulo 4), score, predicted (1 if score >= threshold, else 0), flagged.

    flagged: whether the score reaches the threshold of the document's language, or `threshold` where the labels have
    too few rows of it for one. The language decides nothing else. Held-out labels are never used; of rows that repeat a
    labelled id one text is fitted to. A null id isn't held out. Without labels, or with labels of one class, all rows get
    one score. Null texts count as empty ones; long ones are used whole. Rows that repeat an id stay rows of their own.
    Other columns, whatever their names, don't count. An empty table gives an empty result.
    """
    model, thresholds = fit(docs, labels, text, doc_id, label, lang)
    spoken = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    out = scores(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), spoken.alias("lang"), F.col(f"`{text}`").alias("text")), model).drop("text")
    out = out.withColumn("least", F.lit(None).cast("double")) if thresholds is None else out.join(thresholds, "lang", "left")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    flagged = (F.col("score") >= F.coalesce("least", F.lit(threshold))).alias("flagged")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", predicted, flagged)
