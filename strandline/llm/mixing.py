"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The mix is a row of slots of nearly equally many words. The golden-ratio point of a slot, mapped through the cumulative
targets, says which source fills it; the rank of a slot among those of its source says which block. A source has as many
blocks as the points give it slots: they cut its documents, shuffled by a hash and repeated end to end up to its target,
into equal numbers of words. So the points say in which slots of the mix a document's words stand, and the targets are met
whatever the points. Ranks and places are counted per bucket and then summed over the buckets before, so that no source
is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import cumulated
from .common import staged

#: The golden ratio's fractional part as a binary fraction of so many places, which points are counted in.
PLACES = 60
GOLDEN = 0x9E3779B97F4A7C15 >> 64 - PLACES
WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3
#: Words of a block; slots of a range whose ranks are counted together; buckets that a source's words are shuffled into.
BLOCK, SLOTS_PER_RANGE, WORDS_PER_BUCKET = 512, 8192, 1_000_000
#: Sources (few bytes each) that may be broadcast.
MOST_SOURCES = 100_000


def _few(rows: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def point(n: Column) -> Column:
    """n * GOLDEN modulo 2 ** PLACES, exactly, for n under 2 ** 42: by limbs of 21 bits, none of which overflows."""
    limb = lambda x, i: F.shiftright(x, 21 * i).bitwiseAND(F.lit((1 << 21) - 1).cast("long"))
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    g = [F.lit(GOLDEN >> 21 * i & (1 << 21) - 1).cast("long") for i in range(3)]
    n0, n1 = limb(n, 0), limb(n, 1)
    middle = F.shiftleft(low(n0 * g[1] + n1 * g[0], PLACES - 21), 21)
    high = F.shiftleft(low(n0 * g[2] + n1 * g[1], PLACES - 42), 42)
    return low(n0 * g[0] + middle + high, PLACES)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target of each source. sizes: source, source_size, one row per source.

    Sources are put in the order of code points, null last, and weigh `weights`, repeating. A target is the source's
    share of all words by weight, but at most `epochs` times its size; the excess goes to the others by weight. In the
    order of size by weight, the sources up to some place stop at their most and the others share what is left.
    """
    rows = cumulated(sizes, {"place": F.lit(1)}, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"w": weight, "most": F.col("source_size") * float(epochs)})
    rows = cumulated(rows, {"up_to": F.col("most"), "up_to_w": F.col("w")}, F.col("most") / F.col("w"), "place")
    whole = rows.agg(F.sum("source_size").alias("all"), F.sum("w").alias("all_w"))  # one row
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all") - F.col("up_to") + F.col("most")) / (F.col("all_w") - F.col("up_to_w") + F.col("w")))
    rows = staged(rows.withColumn("stops", F.col("most") < F.col("level") * F.col("w")), "targets")  # level: if this source and those after it shared the rest
    level = rows.where("not stops").agg(F.min(F.struct(F.col("most") / F.col("w"), "place", "level"))["level"].alias("shared"))  # one row
    shared = F.when(F.col("stops"), F.col("most")).otherwise(F.least("most", F.col("shared") * F.col("w")))
    return rows.crossJoin(F.broadcast(level)).select("source", "source_size", shared.alias("target"))


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, slot, rank, base, extra: the slots of the mix that the points give each source, ranked from 0.

    shares: source, target. There is a slot for each `block` words of all targets. A source's whole target is cut by its
    slots: each takes `base` words, the first `extra` of them one more. A source that no point meets, which only one of
    less than three blocks can be, has one slot behind all others, in the order of sources. Points and the sources'
    intervals meet by cells, about four to a source, so that few sources share one.
    """
    spark = shares.sparkSession
    shares = cumulated(shares.where("target >= 1").select("source", F.floor("target").alias("whole")), {"high": F.col("whole"), "number": F.lit(1)}, F.col("source").asc_nulls_last())
    counts = shares.agg(F.sum("whole").alias("all"), F.count("*").alias("n")).first()
    total, bits = counts["all"] or 0, max(2, (4 * counts["n"]).bit_length())
    points = -(-total // block)
    edge = lambda c: (c / F.lit(float(total or 1)) * F.lit(2.0**PLACES)).cast("long")
    shares = staged(shares.select("source", "whole", "number", edge(F.col("high") - F.col("whole")).alias("low"), edge(F.col("high")).alias("high")), "shares")
    cell = lambda x: F.shiftright(x, PLACES - bits)
    cells = shares.where("low < high").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    slots = spark.range(points).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"), F.floor(F.col("id") / SLOTS_PER_RANGE).alias("part")).withColumn("cell", cell(F.col("x")))
    drawn = slots.join(_few(cells, 5 * MOST_SOURCES), "cell").where("x >= low and x < high")
    counts = drawn.groupBy("source", "part").agg(F.count("*").alias("n"))
    own = W.partitionBy("source")
    earlier = own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(own).alias("slots"))
    counts = staged(counts, "slots-by-range")
    ranked = drawn.withColumn("within", F.row_number().over(W.partitionBy("source", "part").orderBy("slot")) - 1)
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    ranked = ranked.select("source", "slot", (F.col("before") + F.col("within")).cast("long").alias("rank"), "whole", "slots")
    missed = shares.join(counts.select("s").distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    missed = missed.select("source", (F.col("number") + (points - 1)).alias("slot"), F.lit(0).cast("long").alias("rank"), "whole", F.lit(1).cast("long").alias("slots"))
    extra = F.col("whole") % F.col("slots")
    return ranked.unionByName(missed).select("source", "slot", "rank", ((F.col("whole") - extra) / F.col("slots")).cast("long").alias("base"), extra.alias("extra"))


def _first_word(rank: Column) -> Column:
    """Where the block of this rank begins among a source's words."""
    return rank * F.col("base") + F.least(rank, F.col("extra"))


def _rank_at(word: Column) -> Column:
    """The rank of the block that a word of a source's lies in."""
    longer = F.col("extra") * (F.col("base") + 1)
    return F.when(word < longer, F.floor(word / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((word - longer) / F.greatest(F.col("base"), F.lit(1)))).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words that the mix takes of it, repeats counted), source,
    first_slot, n_slots (the first slot of the mix that has words of it, and how many do; null and 0 if none is taken).

    size: runs of letters other than \\x20 and \\x09-\\x0D of the whole text, however long; null and empty texts have none,
    and none is taken of them. A null source is a source of its own. No document is taken more than `epochs` times. Rows
    that repeat an id stay rows of their own; other columns, whatever their names, don't count. An empty table gives an
    empty result. Reruns agree: all order comes from ids, sizes and hashes.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(doc_id, source, text).alias("h"))
    sized = staged(sized, "sizes")  # words are counted once
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 20)))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = staged(targets(sizes, weights, epochs), "shares")
    shares = shares.withColumn("buckets", F.ceil(F.col("source_size") / WORDS_PER_BUCKET)).withColumnRenamed("source", "s")
    named = sized.join(_few(shares), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = named.withColumn("bucket", F.when(F.col("buckets") > 0, F.pmod("bucket", F.col("buckets"))).otherwise(F.lit(0)))
    by_bucket = named.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = named.where("size > 0").withColumn("within", within)
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("start") + F.col("within"))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "at")

    slots = staged(schedule(shares.select(F.col("s").alias("source"), "target"), block).withColumnRenamed("source", "s"), "slots")
    cuts = slots.where("rank = 0").select("s", "base", "extra")
    laps = placed.withColumn("lap", F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(epochs)) - 1)))
    laps = laps.withColumn("from", F.col("at") + F.col("lap") * F.col("source_size"))
    laps = laps.withColumn("to", F.least(F.col("from") + F.col("size"), F.floor("target"))).where(F.col("from") < F.col("to"))
    laps = laps.join(_few(cuts), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    pieces = laps.withColumn("rank", F.explode(F.sequence(_rank_at(F.col("from")), _rank_at(F.col("to") - 1))))
    words = F.least("to", _first_word(F.col("rank") + 1)) - F.greatest("from", _first_word(F.col("rank")))
    pieces = pieces.select("doc_id", "source", "size", "source_size", "target", "at", "rank", words.alias("words"))
    met = pieces.join(slots.select("s", "slot", F.col("rank").alias("r")), F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    found = [F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.size(F.collect_set("slot")).cast("long").alias("n_slots")]
    shown = ["doc_id", "size", "source_size", "target"]
    taken = met.groupBy(*shown, "source", "at").agg(*found).select(*shown, "taken", "source", "first_slot", "n_slots")
    nothing = placed.where(F.col("at") >= F.floor("target")).select(*shown, "source").unionByName(named.where("size = 0").select(*shown, "source"))
    zero = F.lit(0).cast("long")
    return taken.unionByName(nothing.select(*shown, zero.alias("taken"), "source", F.lit(None).cast("long").alias("first_slot"), zero.alias("n_slots")))
