"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens that a batch brings for the first time lie behind one another in one array. In each round every sequence
merges all places of its lowest-ranked pair at once; what survives when no pair has a rank is the number of tokens.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counted pre-tokens a worker remembers, and characters and distinct pre-tokens that it handles at once.
REMEMBERED, CHARS_AT_ONCE, NEW_AT_ONCE = 400_000, 4_000_000, 50_000
NO_RANK = np.int64(1) << 40
#: Letters from which a pre-token is merged on its own.
LONG = 256


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordBpe:
    """Counts like the tokenizers library for a BPE with word ends, read from its .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many special tokens it spells out."""
        parts = self.special.split(text)
        found: list[str] = []
        for part in parts:
            part = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))
            found += self.words.findall(part.replace("Σ", "σ").lower())  # a letter's lower case does not depend on its place
        return found, len(parts) - 1

    def lengths(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [t.encode() for t in tokens]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids, ends = self.inner[flat], np.cumsum(size) - 1
        ids[ends] = self.final[flat[ends]]
        owner = np.repeat(np.arange(len(raw)), size)
        counts = np.zeros(len(raw), dtype=np.int64)
        while len(ids):
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            width = np.diff(np.append(starts, len(ids)))
            done = lowest == NO_RANK
            counts[owner[starts[done]]] = width[done]
            hit = (rank == np.repeat(lowest, width)) & (rank != NO_RANK)
            # of places that overlap, as in a run of one symbol, every second one merges, from the left
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1]) if len(place) else place
            within = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place)))) if len(place) else place
            place = place[within % 2 == 0]
            ids[place] = self.merged[rank[place]]
            keep = np.repeat(~done, width)
            keep[place + 1] = False
            ids, owner = ids[keep], owner[keep]
        return counts

    def _rank_of(self, a: int, b: int) -> int:
        pair = a << 32 | b
        at = int(np.searchsorted(self.pairs, pair))
        return int(self.rank[at]) if at < len(self.pairs) and self.pairs[at] == pair else -1

    def long_length(self, token: str) -> int:
        """The same count for one long pre-token: places wait by their rank, so a round touches only what it merges."""
        raw = np.frombuffer(token.encode(), dtype=np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.final[raw[-1]]
        pair = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = np.flatnonzero(self.pairs[at] == pair)
        waiting: dict[int, list[int]] = {}
        for place, rank in zip(known.tolist(), self.rank[at[known]].tolist(), strict=True):
            waiting.setdefault(rank, []).append(place)
        ranks = list(waiting)
        heapq.heapify(ranks)
        ids, n, left = ids.tolist(), len(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while ranks:
            rank = heapq.heappop(ranks)
            for i in sorted(waiting.pop(rank)):
                j = after[i]
                if ids[i] < 0 or j >= n or self._rank_of(ids[i], ids[j]) != rank:
                    continue  # merged meanwhile, as every second place of a run of one symbol
                ids[i], ids[j], after[i], left = int(self.merged[rank]), -1, after[j], left - 1
                if after[i] < n:
                    before[after[i]] = i
                for a, b in ((before[i], i), (i, after[i])):
                    if a >= 0 and b < n and (new := self._rank_of(ids[a], ids[b])) >= 0:
                        if new not in waiting:
                            waiting[new] = []
                            heapq.heappush(ranks, new)
                        waiting[new].append(a)
        return left

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        self.known.update((t, self.long_length(t)) for t in new if len(t) > LONG)
        new = [t for t in new if len(t) <= LONG]
        for i in range(0, len(new), NEW_AT_ONCE):
            part = new[i : i + NEW_AT_ONCE]
            self.known.update(zip(part, self.lengths(part).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        i = 0
        while i < len(texts):
            chars, split = 0, []
            while i < len(texts) and chars < CHARS_AT_ONCE:
                chars += len(texts[i])
                split.append(self.pre_tokens(texts[i]))
                i += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn(set().union(*(tokens for tokens, _ in split)))
            get = self.known.__getitem__
            out += [sum(map(get, tokens)) + special for tokens, special in split]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs without its text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); such columns are replaced.

    tokenizer: path of a BPE .json file that every worker can read. Null and empty texts have 0 bytes and 0 tokens; special
    strings inside a text count as one token each, as the library's default has it. Very long texts and words are counted
    whole. Every row gives one row, repeated ids or not; other columns stay as they are, whatever their names. An empty
    table gives an empty result.
    """

    @F.pandas_udf("long")
    def tokens_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBpe(tokenizer)
        for texts in parts:
            yield pd.Series(bpe.count(texts.tolist()), dtype="int64")

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    found = tokens_of.asNondeterministic()(F.coalesce(F.col(f"`{text}`"), F.lit("")))  # so that it isn't called again for over_limit
    counted = docs.select(*kept, F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), found.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
