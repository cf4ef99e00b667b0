"""Quality classifier: naive-Bayes support vectors.

A text is the set of its n-grams: words and pairs of words, and their shapes (cases, digits, signs) and pairs of shapes,
which carry over to words never seen. Indicators are scaled by the log ratio of their counts in the two classes, and a
linear hinge-loss model is fitted to them by dual coordinate descent. Margins become scores through a logistic curve
fitted to the margins of rows that their fold's model has not seen.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams; labelled rows that a model is fitted to at most (by a hash of their ids); words remembered by a worker.
DIMENSIONS, SAMPLE, REMEMBERED = 1 << 18, 6000, 300_000
#: Smoothing of class counts, weight of a row's loss, rounds over the rows, folds for the curve.
SMOOTHING, COST, ROUNDS, FOLDS = 1.0, 1.0, 12, 4
THRESHOLD = 0.3
_SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: _case(m[0])), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


def _case(letters: str) -> str:
    return "A" if letters.isupper() else "a" if letters.islower() else "Aa"


def shape(word: str) -> str:
    if word.isalpha():  # most words, with or without one sign behind them, need no patterns
        return _case(word)
    if word[:-1].isalpha() and word[-1] in ".,;:!?":
        return _case(word[:-1]) + word[-1]
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return word


class _Words(dict):
    """Numbers of words, whose hashes and hashed shapes are in arrays."""

    def __init__(self):
        self.word, self.shape, self.shapes = array("Q"), array("Q"), {}

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self.word)
        self.word.append(xxhash.xxh64_intdigest(w.lower()))
        form = shape(w)
        if form not in self.shapes:
            self.shapes[form] = xxhash.xxh64_intdigest(form, 1)
        self.shape.append(self.shapes[form])
        return n

    def ngrams(self, text: str) -> np.ndarray:
        """The text's n-grams as sorted numbers under DIMENSIONS."""
        if len(self) > REMEMBERED:
            self.clear()
            self.word, self.shape, self.shapes = array("Q"), array("Q"), {}
        found = text.split()
        if not found:
            return np.empty(0, dtype="i4")
        at = np.fromiter(map(self.__getitem__, found), dtype="i8", count=len(found))
        word, form = np.frombuffer(self.word, dtype="u8")[at], np.frombuffer(self.shape, dtype="u8")[at]
        k = np.uint64(0x9E3779B97F4A7C15)
        same = (word[1:] == word[:-1]).astype("u8")
        parts = [word, form, word[:-1] * k ^ word[1:], form[:-1] * k ^ (form[1:] + same)]
        mixed = np.concatenate(parts) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(46)
        return np.unique(mixed).astype("i4") if len(mixed) < 4000 else np.flatnonzero(np.bincount(mixed.astype("i8"), minlength=DIMENSIONS)).astype("i4")


@dataclass
class Model:
    weights: np.ndarray  # of the ratio-scaled indicators, times the ratios
    ratios: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, grams: np.ndarray) -> float:
        if not len(grams):
            return self.bias
        return float(self.weights[grams].sum() / max(np.sqrt(np.square(self.ratios[grams], dtype="f8").sum()), 1e-9) + self.bias)

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -30, 30))))


def _ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    logs = []
    for side in (True, False):
        count = np.full(DIMENSIONS, SMOOTHING)
        for grams, g in zip(rows, good, strict=True):
            if g == side:
                count[grams] += 1
        logs.append(np.log(count / count.sum()))
    return (logs[0] - logs[1]).astype("f4")


def _descend(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Dual coordinate descent for the hinge loss; each class weighs as much as the other."""
    ratios = _ratios(rows, good)
    sign = np.where(good, 1.0, -1.0)
    most = COST * np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    values = [ratios[g] / max(float(np.linalg.norm(ratios[g])), 1e-9) for g in rows]
    weights, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(0)
    for _ in range(ROUNDS):
        for i in draw.permutation(len(rows)):
            grams, x = rows[i], values[i]
            slope = sign[i] * (weights[grams] @ x + bias) - 1
            new = min(max(dual[i] - slope / 2, 0.0), most[i])  # x and the bias have the squared length 2
            step, dual[i] = (new - dual[i]) * sign[i], new
            if step:
                weights[grams] += step * x
                bias += step
    return Model((weights * ratios).astype("f4"), ratios, bias)


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    n, p = len(good), int(good.sum())
    goal = np.where(good, (p + 1) / (p + 2), 1 / (n - p + 2))
    x, theta = np.c_[margins, np.ones(n)], np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-6 * np.eye(2), x.T @ (q - goal) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> Model:
    if not len(rows) or good.all() or not good.any():  # nothing to tell apart
        flat = np.zeros(DIMENSIONS, dtype="f4")
        return Model(flat, flat, 0.0, 1.0, 3.0 if len(rows) and good.all() else -3.0 if len(rows) else 0.0)
    model = _descend(rows, good)
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        train = fold != k
        if good[train].all() or not good[train].any():
            margins[~train] = [model.margin(rows[i]) for i in np.flatnonzero(~train)]
            continue
        part = _descend([rows[i] for i in np.flatnonzero(train)], good[train])
        margins[~train] = [part.margin(rows[i]) for i in np.flatnonzero(~train)]
    model.slope, model.shift = _curve(margins, good)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of labels that aren't held out. At most `sample` of them, in the order of a hash of their ids, are used.

    Their n-grams, of bounded number, meet in one task; what comes to the driver is the model, of fixed size.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~is_held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "good": batch["good"], "grams": [words.ngrams(t).tobytes() for t in batch["text"]]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([b for b in batches] or [pd.DataFrame({"id": [], "good": [], "grams": []})])
        got = got.sort_values("id")
        model = fit_rows([np.frombuffer(g, dtype="i4") for g in got["grams"]], got["good"].to_numpy(dtype=bool))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "ratios": [model.ratios.tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("_id"))
    grams = texts.select("id", "text", (F.col("_label") == 1).alias("good")).mapInPandas(features, "id long, good boolean, grams binary")
    # of rows that repeat a labelled id the one of the least n-grams counts, so no more than `sample` rows meet
    grams = grams.groupBy("id").agg(F.min(F.struct(F.xxhash64("grams").alias("h"), "grams", "good")).alias("x")).select("id", "x.good", "x.grams")
    row = grams.repartition(1).mapInPandas(fitted, "weights binary, ratios binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(row["weights"], dtype="f4"), np.frombuffer(row["ratios"], dtype="f4"), row["bias"], row["slope"], row["shift"])


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) added; only the text decides, whole, however long.

    Null texts score as empty ones. A column score is replaced, all others stay as they are, whatever their names; rows
    that repeat an id stay rows of their own; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, m = _Words(), model.value
        for texts in parts:
            yield pd.Series([m.score(words.ngrams(t)) for t in texts], dtype="f8")

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    return docs.select(*kept, score_of.asNondeterministic()(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("score"))  # not called again for each use


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is 0 modulo 5), score, predicted (1 if score >= threshold, else 0).

    Held-out labels are never used; of rows that repeat a labelled id one text is fitted to. A null id isn't held out.
    Without labels, or with labels of one class, all rows get one score. Null texts count as empty ones; long ones are used
    whole. Rows that repeat an id stay rows of their own. Other columns, whatever their names, don't count. An empty table
    gives an empty result.
    """
    model = fit(docs, labels, text, doc_id, label)
    out = scores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model).drop("text")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
