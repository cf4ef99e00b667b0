"""The de Bruijn graph as tables of nodes and edges, and the filters at its forks.

A node's successors share all its bases but the first, so nodes meet their successors by k - 1 bases in one shuffle; all
that the filters need of a fork are the counts and strand fractions of at most four successors, kept as eight columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packing import MOST_PACKED, Packing
from ..functions.staging import staged
from . import junctions
from .kmers import MOST_CHOSEN, strand_fraction

# The order of bases in masks and ties, the part of `fraction` that strand filters use, the count from which
# a successor is well supported, and the steps that a way out of a fork must have at least.
ORDER = "ACTG"
STRAND_PART = 0.1
STRONG, WAY_OUT = 5, 100
_SLOTS = range(4)


def oriented(kmers: DataFrame, k: int) -> DataFrame:
    """src, node, flipped: each k-mer (packed) in both directions, a palindrome once."""
    both = F.array_distinct(F.array("kmer", Packing(k).revcomp(F.col("kmer"))))
    return kmers.select(F.col("kmer").alias("node"), F.explode(both).alias("src")).select("src", "node", (F.col("src") != F.col("node")).alias("flipped"))


def edges(kmers: DataFrame, k: int) -> DataFrame:
    """mid, src, node, flipped, nt (place of the added base in ACTG), dst, cnt and plus_frac of dst as oriented.

    mid: the k - 1 bases that src and dst share. A k-mer isn't its own successor in either direction. kmers is read twice.
    """
    pack, part = Packing(k), F.col("plus_q") / 65535
    both = F.array_distinct(F.array("kmer", pack.revcomp(F.col("kmer"))))
    rows = strand_fraction(kmers).select(F.col("kmer").alias("node"), "cnt", part.alias("part"), F.explode(both).alias("src")).withColumn("flipped", F.col("src") != F.col("node"))
    left = rows.select(pack.suffix(F.col("src")).alias("mid"), "src", "node", "flipped")
    right = rows.select(pack.prefix(F.col("src")).alias("mid"), pack.last(F.col("src")).alias("nt"), F.col("node").alias("kmer"), "cnt", F.when(F.col("flipped"), 1 - F.col("part")).otherwise(F.col("part")).alias("plus_frac"))
    met = left.join(right, "mid").where("kmer <> node")
    return met.select("mid", "src", "node", "flipped", "nt", pack.extend(F.col("mid"), F.col("nt")).alias("dst"), "cnt", "plus_frac")


def branches(kmers: DataFrame, k: int) -> DataFrame:
    """kmer, branch: bits 0-3 for successors of the k-mer, bits 4-7 for those of its reverse complement, by base in ACTG.

    Of a palindrome both halves are set alike.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.col("nt"))
    bits = F.when(Packing(k).revcomp(F.col("node")) == F.col("node"), bit * 17).when(F.col("flipped"), bit * 16).otherwise(bit)
    found = edges(kmers, k).select(F.col("node").alias("kmer"), bits.alias("bits")).unionByName(kmers.select("kmer", F.lit(0).alias("bits")))
    return found.groupBy("kmer").agg(F.bit_or("bits").alias("branch"))


def forks_of(kmers: DataFrame, k: int, low_count: int) -> DataFrame:
    """src, c0-c3, f0-f3: count and plus fraction of each node's successors by base (null: none), of at least low_count."""
    if 1 < k <= MOST_PACKED:
        return junctions.forks_of(kmers, k, low_count)
    steps = edges(kmers, k).where(F.col("cnt") >= low_count)
    slots = [F.max(F.when(F.col("nt") == i, F.col(x))).alias(f"{x[0] if x == 'cnt' else 'f'}{i}") for x in ("cnt", "plus_frac") for i in _SLOTS]
    return steps.groupBy("mid", "src").agg(*slots).drop("mid")  # partitioned by mid already


def _n(prefix: str = "c") -> Column:
    return reduce(lambda a, b: a + b, (F.col(f"{prefix}{i}").isNotNull().cast("int") for i in _SLOTS))


def several() -> Column:
    """Whether a node has more than one successor."""
    return _n() > 1


def _greatest(of) -> Column:
    return F.greatest(*(of(i) for i in _SLOTS))


def _kept(forks: DataFrame, keep) -> DataFrame:
    """forks without the successors that keep(i) is false for, where there are several."""
    alone = _n() < 2
    rest = [c for c in forks.columns if c not in {f"{x}{i}" for x in "cf" for i in _SLOTS}]
    return forks.select(*rest, *(F.when(alone | keep(i), F.col(f"{x}{i}")).alias(f"{x}{i}") for x in "cf" for i in _SLOTS))


def by_abundance(forks: DataFrame, fraction: float, low_count: int) -> DataFrame:
    """Drops successors at or under a fraction of the fork's count, and single ones beside a strong one at low_count 1."""
    total = reduce(lambda a, b: a + b, (F.coalesce(f"c{i}", F.lit(0)) for i in _SLOTS))
    rows = forks.withColumns({"_least": F.floor(F.lit(fraction) * total), "_top": _greatest(lambda i: F.col(f"c{i}"))})

    def keep(i: int) -> Column:
        count = F.col(f"c{i}")
        good = count > F.col("_least")
        return good & ~((F.col("_top") > STRONG) & (count == 1)) if low_count == 1 else good

    return _kept(rows, keep).drop("_least", "_top")


def by_ggt(forks: DataFrame, k: int, fraction: float) -> DataFrame:
    """Beside a well supported successor that ends in GGT, drops those with hardly any count on the minus strand."""
    minus = lambda i: F.col(f"c{i}") * (1 - F.col(f"f{i}"))
    t = ORDER.index("T")
    rows = forks.withColumn("_target", F.when(Packing(k).tail(F.col("src"), "GG") & (F.col(f"c{t}") > STRONG), minus(t)) if k > 2 else F.lit(None).cast("double"))
    return _kept(rows, lambda i: F.col("_target").isNull() | (minus(i) >= STRAND_PART * fraction * F.col("_target"))).drop("_target")


def by_strand_balance(forks: DataFrame, fraction: float, low_count: int) -> DataFrame:
    """Where a successor is seen on both strands, drops those that are seen on one only."""
    least = lambda i: F.least(F.col(f"f{i}"), 1 - F.col(f"f{i}"))
    most = lambda i: F.greatest(F.col(f"f{i}"), 1 - F.col(f"f{i}"))
    both = reduce(lambda a, b: a | b, (F.coalesce((F.col(f"c{i}") >= low_count) & (least(i) > 0.25), F.lit(False)) for i in _SLOTS))
    rows = forks.withColumn("_both", both)
    return _kept(rows, lambda i: ~F.col("_both") | (F.col(f"c{i}") <= 1) | (least(i) >= STRAND_PART * fraction * most(i))).drop("_both")


def filtered(forks: DataFrame, k: int, fraction: float = 0.1, low_count: int = 2, stranded: bool = True) -> DataFrame:
    """The successors that survive, in the order abundance, GGT, strand balance; no shuffle."""
    out = by_abundance(forks, fraction, low_count)
    return by_strand_balance(by_ggt(out, k, fraction), fraction, low_count) if stranded else out


def successors(forks: DataFrame, k: int) -> DataFrame:
    """src, nt, dst, cnt, plus_frac: one row for each successor that is left."""
    each = F.array(*(F.struct(F.lit(i).alias("nt"), F.col(f"c{i}").alias("cnt"), F.col(f"f{i}").alias("plus_frac")) for i in _SLOTS))
    rows = forks.select("src", F.inline(each)).where("cnt is not null")
    return rows.select("src", "nt", Packing(k).step(F.col("src"), F.col("nt")).alias("dst"), "cnt", "plus_frac")


def mutual(steps: DataFrame, k: int) -> DataFrame:
    """src, dst of the steps whose reverse is a step, too."""
    pack = Packing(k)
    rows = steps.select("src", "dst", pack.revcomp(F.col("dst")).alias("_r"), pack.revcomp(F.col("src")).alias("_s"))
    ahead = F.col("src") <= F.col("_r")
    rows = rows.select(F.when(ahead, F.col("src")).otherwise(F.col("_r")).alias("a"), F.when(ahead, F.col("dst")).otherwise(F.col("_s")).alias("b"), F.when(F.col("src") == F.col("_r"), 3).when(ahead, 1).otherwise(2).alias("way"))
    found = rows.groupBy("a", "b").agg(F.bit_or("way").alias("ways")).where("ways = 3")
    ways = F.array_distinct(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(pack.revcomp(F.col("b")).alias("src"), pack.revcomp(F.col("a")).alias("dst"))))
    return found.select(F.inline(ways))


def unique_edges(forks: DataFrame, k: int, together: bool = False) -> DataFrame:
    """src, dst: a node's only successor that has, walked back, the node as its only one.

    together: forks are forks_of after filters, read from no table; the step back is then found where the step stands. Else
    they are staged first: the optimizer would put the filters' expressions into one another to push the choice down.
    """
    if together and 1 < k <= MOST_PACKED:
        return junctions.unique_edges(forks, k)
    return mutual(successors(staged(forks, "forks").where(_n() == 1), k), k)


def ranked(forks: DataFrame, k: int) -> DataFrame:
    """successors with rank: the place of a successor at its fork, by count and then by base."""
    order = F.array_sort(F.filter(F.array(*(F.struct((-F.col(f"c{i}")).alias("less"), F.lit(i).alias("nt")) for i in _SLOTS)), lambda s: s["less"].isNotNull()))
    rows = forks.select("src", F.posexplode(order).alias("rank", "s"))
    return rows.select("src", Packing(k).step(F.col("src"), F.col("s.nt")).alias("dst"), (F.col("rank") + 1).alias("rank"), (-F.col("s.less")).alias("cnt"))


def ends(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """src, is_head, is_tail of the oriented nodes where a path begins or ends."""
    rows = nodes.select("src", F.lit(0).alias("way"))
    rows = rows.unionByName(kept.select("src", F.lit(1).alias("way"))).unionByName(kept.select(F.col("dst").alias("src"), F.lit(2).alias("way")))
    out = rows.groupBy("src").agg(F.bit_or("way").alias("ways")).where("ways < 3")
    return out.select("src", F.col("ways").isin(0, 1).alias("is_head"), F.col("ways").isin(0, 2).alias("is_tail"))


def near(starts: DataFrame, steps: DataFrame, most: int, few: int = MOST_CHOSEN) -> DataFrame:
    """The steps (src, ..., dst; a table) that walks of up to `most` steps from starts (src) can take; or all steps.

    While a round meets at most `few` nodes they are broadcast, and the steps stay where they are; of the starts there may
    be more. Where a later round meets more, little would be gained, and all steps are given.
    """
    front, found = staged(starts.select("src").distinct(), "near"), None
    for i in range(most):
        n = front.limit(few + 1).count()
        if not n:
            break
        if n > few and i:
            return steps
        taken = staged(steps.join(front if n > few else F.broadcast(front), "src", "left_semi").select(*steps.columns), "near")
        found = taken if found is None else found.unionByName(taken)
        if i + 1 < most:
            front = staged(taken.select(F.col("dst").alias("src")).distinct().join(found.select("src"), "src", "left_anti"), "near")
    return steps if found is None else found


def reachable(starts: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """start, node, depth: the nodes within `most` steps (a table) of each start (src), with the fewest steps that lead there.

    A bounded number of rounds, each written to the shared folder; a start reaches itself only around a ring.
    """
    links = near(starts, steps, most).select("src", "dst")
    front, found = starts.select(F.col("src").alias("start"), F.col("src").alias("node")).distinct(), None
    for depth in range(1, most + 1):
        front = front.join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if found is not None:
            front = front.join(found, ["start", "node"], "left_anti")
        front = staged(front.withColumn("depth", F.lit(depth)), "frontier")
        found = front if found is None else found.unionByName(front)
        front = front.drop("depth")
    return found


def unique_paths(pairs: DataFrame, forks: DataFrame, k: int, most: int, at_once: int = 100) -> DataFrame:
    """start, goal, path (bases) of the pairs (start: a node, goal: a canonical k-mer) that one walk alone connects. forks: a table.

    Walks of all pairs grow step by step, each round written to the shared folder. The first step that brings any of a
    pair's walks to its goal decides: one walk is the path, several are none; so are more than `at_once` walks that go on,
    which is a rule of the search.
    """
    pack = Packing(k)
    steps = near(pairs.select(F.col("start").alias("src")), successors(forks, k).select("src", "nt", "dst"), most)
    walks, found = pairs.select("start", "goal", F.col("start").alias("node"), F.lit("").alias("path")), None
    for _ in range(most):
        grown = walks.join(steps, F.col("node") == F.col("src")).select("start", "goal", F.col("dst").alias("node"), F.concat("path", F.substring(F.lit(ORDER), F.col("nt") + 1, F.lit(1))).alias("path"))
        grown = staged(grown.withColumn("there", pack.canonical(F.col("node")) == F.col("goal")), "grown")
        state = grown.groupBy("start", "goal").agg(F.sum(F.col("there").cast("long")).alias("hits"), F.count("*").alias("n"), F.max(F.when(F.col("there"), F.col("path"))).alias("path"))
        hit = state.where("hits = 1").select("start", "goal", "path")
        found = hit if found is None else found.unionByName(hit)
        going = state.where((F.col("hits") == 0) & (F.col("n") <= at_once)).select("start", "goal")
        walks = grown.join(going, ["start", "goal"]).select("start", "goal", "node", "path")
    return found


def forking(steps: DataFrame) -> DataFrame:
    """src of the nodes that have more than one successor."""
    return steps.groupBy("src").agg(F.count("*").alias("_n")).where("_n > 1").select("src")


def paths(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """src, head, step: each oriented node with the first node of its path and its place in it, by pointer doubling.

    kept: src, dst, at most one edge out of and into a node. A cycle begins at its smallest node. Each round doubles the
    steps that a pointer reaches back and is written to the shared folder; nodes that have arrived aren't written again.
    """
    at = nodes.select("src").join(kept.select(F.col("dst").alias("src"), F.col("src").alias("back")), "src", "left")
    at = at.select("src", F.coalesce("back", "src").alias("back"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("step"), F.col("back").isNull().alias("done"), F.least("src", "back").alias("least"))
    at = staged(at, "paths")
    arrived, moving, reach, before = at.where("done"), at.where("not done"), 1, None
    while True:
        left = moving.count()
        if not left or left == before and reach > left:  # only cycles are left, and each has been walked around
            break
        before, reach = left, 2 * reach
        to = arrived.unionByName(moving).select(F.col("src").alias("back"), F.col("back").alias("b"), F.col("step").alias("s"), F.col("done").alias("d"), F.col("least").alias("l"))
        moved = moving.join(to, "back").select("src", F.col("b").alias("back"), (F.col("step") + F.col("s")).alias("step"), F.col("d").alias("done"), F.least("least", "l").alias("least"))
        moved = staged(moved, "paths")
        arrived, moving = arrived.unionByName(moved.where("done")), moved.where("not done")
    lines = arrived.select("src", F.col("back").alias("head"), "step")
    if not left:
        return lines
    rings = moving.select("src", "least")
    cut = kept.join(rings.select(F.col("least").alias("dst")).distinct(), "dst", "left_anti")  # open each ring before its smallest node
    return lines.unionByName(paths(rings, cut.join(rings.select("src"), "src", "left_semi")))


def with_way_out(starts: DataFrame, forks: DataFrame, kmers: DataFrame, k: int, least: int | None = None) -> DataFrame:
    """src of those starts (src) from which a walk of `least` steps leads on in forks (filtered by abundance).

    Its k-th step must be one that can be walked back. Nodes between forks are passed in one go, as paths; a walk is held
    by its start, node and number of steps, behind the k-th step only with the most steps. Each round, of which there are
    as many as a walk meets forks, is written to the shared folder and holds the walks that go on.
    """
    least = max(WAY_OUT, k) if least is None else least
    steps = successors(forks, k).select("src", "dst")
    there = staged(steps.join(mutual(steps, k).withColumn("back", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("back", F.lit(False)).alias("back")), "steps")
    placed = staged(paths(oriented(kmers, k), unique_edges(forks, k)), "ways")
    lines = placed.groupBy("head").agg(F.max("step").alias("last"), F.max_by("src", "step").alias("tail"))
    placed = staged(placed.join(lines, "head").select(F.col("src").alias("node"), "tail", (F.col("last") - F.col("step")).alias("more")), "ways")
    walks = starts.select(F.col("src").alias("start"), F.col("src").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    out = None
    while True:
        at = walks.join(placed, "node").select("start", "tail", (F.col("depth") + F.col("more")).alias("depth"))
        at = staged(at, "walks")
        arrived = at.where(F.col("depth") >= least).select("start").distinct()
        out = arrived if out is None else out.unionByName(arrived)
        going = at.where(F.col("depth") < least).join(arrived, "start", "left_anti")
        if not going.limit(1).count():
            return out.distinct().select(F.col("start").alias("src"))
        walks = going.join(there, F.col("tail") == F.col("src")).where((F.col("depth") + 1 != k) | F.col("back")).select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
        early = F.when(F.col("depth") <= k, F.col("depth")).otherwise(F.lit(k + 1))
        walks = walks.groupBy("start", "node", early.alias("early")).agg(F.max("depth").alias("depth")).drop("early")


def contested(forks: DataFrame) -> DataFrame:
    """The forks whose dead ends are trimmed: those with a well supported successor among several."""
    return forks.where((_n() > 1) & (_greatest(lambda i: F.col(f"c{i}")) > STRONG))


def fully_filtered(kmers: DataFrame, k: int, fraction: float = 0.1, low_count: int = 2, stranded: bool = True) -> DataFrame:
    """Forks after all filters: abundance, GGT, dead ends beside a well supported successor, strand balance.

    kmers is read several times, so it should be a table.
    """
    whole = staged(by_abundance(forks_of(kmers, k, low_count), fraction, low_count), "forks")
    forks = by_ggt(whole, k, fraction) if stranded else whole
    tried = staged(successors(contested(forks), k).select("src", "dst"), "tried")
    if tried.isEmpty():  # no dead end can be beside a well supported successor, so no walk is needed
        return by_strand_balance(forks, fraction, low_count) if stranded else forks
    good = with_way_out(tried.select(F.col("dst").alias("src")), whole, kmers, k)
    dead = staged(tried.join(good.withColumnRenamed("src", "dst"), "dst", "left_anti"), "dead-ends")
    lost = dead.groupBy("src").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), Packing(k).last(F.col("dst")))).alias("_lost"))
    rows = forks.join(lost, "src", "left")
    gone = lambda i: F.coalesce(F.col("_lost").bitwiseAND(1 << i) != 0, F.lit(False))
    rows = rows.select("src", *(F.when(~gone(i), F.col(f"{x}{i}")).alias(f"{x}{i}") for x in "cf" for i in _SLOTS))
    return by_strand_balance(rows, fraction, low_count) if stranded else rows
