"""SimHash near-duplicates by ball hashing that meets in the middle.

Of two fingerprints that differ in at most three bits, one of three blocks of the bits holds at least one of them, so the
other two blocks differ in two bits or less. For each two blocks a fingerprint emits all variants within one bit, half of
that radius, so both emit the one in the middle: 131 keys of 42 or 43 bits, which keeps groups of strangers small for
tables of billions (whole fingerprints would take 2081 variants within two bits). Variants are shuffled; in each group of
equal variants the pairs are verified on all 64 bits, and enough links to connect them are kept.
A group too large for that sends its members on to whole-fingerprint balls: there all variants within one and within
two bits meet, so whatever meets a variant within one bit is linked by construction and one star per group links all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, id_of, join_hot, key_of, shuffle_partitions, staged
from .components import smallest_reachable

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORDS, SEED, RADIUS = 3, 42, 3
#: Shingles whose bits are summed at once; members of a group that are still compared with each other.
SHINGLES_AT_ONCE, COMPARED = 100_000, 2048
#: The blocks of bits, of which one is left out.
BLOCKS = [((1 << n) - 1) << at for at, n in ((0, 22), (22, 21), (43, 21))]


def _hashes(text: str, words: int) -> list[int]:
    found = text.encode().translate(LOWERED).split()  # splits at \x20 and \x09-\x0D
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.r_[0, ends[:-words]].tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def _majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """The fingerprint of each of the ragged lists, none of them empty."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = np.array(sizes)
    ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def simhashes(texts: list[str], words: int = WORDS) -> np.ndarray:
    out = np.zeros(len(texts), dtype="<u8")
    held: list[int] = []
    sizes: list[int] = []
    owners: list[int] = []
    for i, text in enumerate([*texts, None]):
        if text is not None and (h := _hashes(text, words)):
            held += h
            sizes.append(len(h))
            owners.append(i)
        if held and (text is None or len(held) >= SHINGLES_AT_ONCE):
            out[owners] = _majority(held, sizes)
            held, sizes, owners = [], [], []
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """key (doc_id, a null one as a number of its own), fp (the fingerprint as a signed long) and the longs `more` of each row."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = simhashes(batch.pop("text").tolist()).view("<i8")
            yield batch.assign(fp=fps)[["key", "fp", *more]]

    rows = docs.select(key_of(F.col(doc_id)).alias("key"), F.coalesce(text, F.lit("")).alias("text"), *more)
    return rows.mapInPandas(hashed, ", ".join(f"{c} long" for c in ("key", "fp", *more)))


def _block_balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            fp = batch["fp"].to_numpy()[i : i + 2000]
            for block in BLOCKS:
                flips = np.array([0, *(1 << b for b in range(64) if not block >> b & 1)], dtype="u8")
                variants = (fp.view("u8") & ~np.uint64(block))[:, None] ^ flips[None, :]
                yield pd.DataFrame({"variant": variants.ravel().view("i8"), "fp": np.repeat(fp, len(flips))})


def _whole_balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    flips, far = np.array(masks, dtype="u8"), np.repeat(np.array([0, 1], dtype="int32"), [65, 2016])
    for batch in batches:
        for i in range(0, len(batch), 200):
            fp = batch["fp"].to_numpy()[i : i + 200].view("u8")
            yield pd.DataFrame({"variant": (fp[:, None] ^ flips).ravel().view("i8"), "far": np.tile(far, len(fp)), "node": np.repeat(fp.view("i8"), len(flips))})


def _roots(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each member of a group the first member of its component, where pairs within the radius are linked."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    root = np.arange(len(fp))
    while True:
        least = np.where(near, root[None, :], len(fp)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _rows(u: np.ndarray, v: np.ndarray | None) -> pd.DataFrame:
    return pd.DataFrame({"u": u.view("i8"), "v": pd.array(v.view("i8") if v is not None else [pd.NA] * len(u), dtype="Int64")})


def _verified(compared: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of their variants. u, v: a link, or u is to go on (v is null) because its group is too large."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        dense = False

        def groups(variant: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
            if not len(variant):
                return
            first = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
            size = np.diff(np.append(first, len(variant)))
            at = first[size == 2]
            at = at[np.bitwise_count(fp[at] ^ fp[at + 1]) <= RADIUS]
            us, vs, on = [fp[at]], [fp[at + 1]], [fp[:0]]
            for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = fp[a : a + n]
                if n > compared:
                    on.append(own)
                    continue
                root = _roots(own, RADIUS)
                linked = root != np.arange(n)
                us.append(own[linked])
                vs.append(own[root[linked]])
            yield _rows(np.concatenate(us), np.concatenate(vs))
            yield _rows(np.concatenate(on), None)

        for batch in batches:
            new = batch["variant"].to_numpy(), batch["fp"].to_numpy().view("u8")
            if not len(new[0]):
                continue
            variant, fp = (np.concatenate(x) for x in zip(*held, new, strict=True)) if held else new
            cut = int(np.searchsorted(variant, variant[-1]))  # the last group may go on in the next batch
            if cut:
                whole = 0
                if dense:  # the group that was held had begun earlier; what is left of it is as dense
                    whole = int(np.searchsorted(variant, variant[0], side="right"))
                    yield _rows(fp[:whole], None)
                    dense = False
                yield from groups(variant[whole:cut], fp[whole:cut])
            held = [(variant[cut:], fp[cut:])]
            if len(variant) - cut > compared:
                dense = True
                yield _rows(fp[cut:], None)
                held = [(variant[-1:], fp[-1:])]
        if held and dense:
            yield _rows(held[0][1], None)
        elif held:
            yield from groups(*held[0])

    return verify


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of their variants, near ones first: every member of a group that has a near one is linked to it."""
    last, hub = None, 0
    for batch in batches:
        variant, far, node = batch["variant"].to_numpy(), batch["far"].to_numpy(), batch["node"].to_numpy()
        if not len(variant):
            continue
        first = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        group = np.cumsum(np.r_[False, variant[1:] != variant[:-1]])
        centre, has = node[first].copy(), far[first] == 0
        if last is not None and last[0] == variant[0]:
            centre[0], has[0] = hub, last[1]
        last, hub = (variant[-1], bool(has[-1])), centre[-1]
        on = has[group] & (node != centre[group])
        yield pd.DataFrame({"u": node[on], "v": centre[group][on]})


def near_links(reps: DataFrame, compared: int = COMPARED) -> DataFrame:
    """u, v: links enough to connect all fingerprints that differ in at most three bits. reps: fp, each once."""
    n = shuffle_partitions(reps.sparkSession)
    balls = reps.mapInPandas(_block_balls, "variant long, fp long")
    met = balls.repartition(n, "variant").sortWithinPartitions("variant").mapInPandas(_verified(compared), "u long, v long")
    met = staged(met, "simhash-links")
    dense = met.where("v is null").select(F.col("u").alias("fp")).distinct()
    whole = dense.mapInPandas(_whole_balls, "variant long, far int, node long").repartition(n, "variant").sortWithinPartitions("variant", "far", "node")
    links = met.where("v is not null").distinct()
    return links.unionByName(whole.mapInPandas(_stars, "u long, v long")) if dense.limit(1).count() else links


def _named(fps: DataFrame, first: Column, compared: int) -> tuple[DataFrame, int]:
    """fp, first (the least of the component) and n (its rows) for each fingerprint of fps, and the number of all rows."""
    least = staged(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "simhash-reps")
    roots = smallest_reachable(near_links(least.select("fp"), compared), "simhash-components").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    least = staged(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    groups = least.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("size"))
    sizes = groups.agg(F.sum("size")).first()[0] or 0
    return staged(join_hot(least.drop("first"), groups, "root", "size", sizes).drop("root"), "simhash-named"), least.agg(F.sum("n")).first()[0] or 0


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", compared: int = COMPARED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most 3 bits) of each row.

    Null and empty texts have the fingerprint zero and are linked like any other. Rows that repeat an id stay rows of
    their own and link nothing by it, so components apart may have the same component_id; a null id, as the smallest,
    names its component null. Very long texts are hashed in parts. Other columns, whatever their names, don't count. An
    empty table gives an empty result.
    """
    fps = staged(fingerprints(docs, text, doc_id), "simhash-fps")
    named, total = _named(fps, F.col("key"), compared)
    return join_hot(fps, named, "fp", "n", total).select(id_of(F.col("key")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_of(F.col("first")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", compared: int = COMPARED) -> DataFrame:
    """docs with one row of each group of near duplicates: the one of the smallest id, of rows that repeat it the one of
    the smallest hash of the text, then of the row, and one of those that are alike in all of this.

    Null ids are the smallest; null and empty texts are one group. All columns come back as they are, whatever their
    names; an empty table gives an empty result.
    """
    own = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key_of(F.col(doc_id)).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.xxhash64(*own).alias("hash"))
    fps = staged(fingerprints(marked.drop("row"), "text", "key", ("mark", "hash")), "simhash-fps")
    named, _ = _named(fps, F.struct("key", "mark", "hash"), compared)
    chosen = named.select("first.key", "first.mark", "first.hash").distinct()
    found = marked.drop("text").join(chosen, ["key", "mark", "hash"])
    return found.groupBy("key", "mark", "hash").agg(F.first("row").alias("row")).select("row.*")
