"""Registered queries over the nucleotide projection of the tables, and the same in SQL.

Every query takes whole tables and whole texts. k is 21 where nothing else is said.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as X
from .functions import tables
from .functions.ordering import ranked_rows
from .functions.staging import staged
from .operators import chunks, contig_graph, contigs, graph, kmers, mapping, pairs, stats
from .sources import projection, reads, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
K, MIN_COUNT, FRACTION, LOW_COUNT, MARGIN, ADAPTER_LIMIT = 21, 2, 0.1, 2, 50, 15

_L = projection.LETTERS
_SEQ = f"translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_L}{_L.upper()}', '{projection.BASES}{projection.BASES}')"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_ORD = "translate({0}, 'ACTG', '0123')"


def _canon(x: str) -> str:
    return f"case when {_ORD.format(x)} < {_ORD.format(_RC.format(x))} then {x} else {_RC.format(x)} end"


def _windows(name: str, source: str, key: str, k: int = K) -> str:
    """CTE `name`: key, pos, kmer, is_plus of the windows of source's seq."""
    at = f"{name}_at as (select {key}, seq, unnest(range(1, length(seq) - {k} + 2)) as p from {source} where length(seq) >= {k})"
    raw = f"{name}_raw as (select {key}, p - 1 as pos, substr(seq, p, {k}) as w from {name}_at)"
    return f"{at}, {raw}, {name} as (select {key}, pos, {_canon('w')} as kmer, {_ORD.format('w')} < {_ORD.format(_RC.format('w'))} as is_plus from {name}_raw)"


_READS = f"reads as (select doc_id as read_id, {_SEQ} as seq from documents)"
_TARGETS = f"targets as (select item_id as target_id, {_SEQ} as seq from benchmark)"
_MATES = f"mates as (select conv_id || ':' || (turn // 2) as pair_id, cast(turn % 2 + 1 as integer) as mate, {_SEQ} as seq from conversations)"
_COUNTS = f"{_READS}, {_windows('kw', 'reads', 'read_id')}, counts as (select kmer, count(*) as cnt, cast(sum(is_plus::int) as bigint) as plus from kw group by kmer)"
_KMERS = f"{_COUNTS}, kmers as materialized (select * from counts where cnt >= {MIN_COUNT})"
_EDGES = f"""{_KMERS},
both_ways as (select distinct node, src from (select kmer as node, kmer as src from kmers union all select kmer, {_RC.format('kmer')} from kmers)),
steps as (select src, node, nt, substr(src, 2) || base as dst from both_ways, (values (0, 'A'), (1, 'C'), (2, 'T'), (3, 'G')) b(nt, base)),
known as (select src, node, nt, dst, {_canon('dst')} as kmer from steps),
edges as (select src, node, src <> node as flipped, nt, dst, cnt, case when dst <> k.kmer then 1 - q else q end as plus_frac from known k
    join (select kmer, cnt, cast(floor(plus::double / cnt * 65535 + 0.5) as integer) / 65535::double as q from kmers) m on k.kmer = m.kmer where k.kmer <> k.node)"""
_ABUNDANCE = f"""{_EDGES},
by_abundance as (select src, node, flipped, nt, dst, cnt, plus_frac from (select *, count(*) over (partition by src) as n, sum(cnt) over (partition by src) as total from edges where cnt >= {LOW_COUNT})
    where n = 1 or cnt > floor({FRACTION} * total))"""
_GGT = f"""{_ABUNDANCE},
by_ggt as (select src, node, flipped, nt, dst, cnt, plus_frac from (select *, count(*) over (partition by src) as n,
    max(case when ends_with(dst, 'GGT') and cnt > 5 then cnt * (1 - plus_frac) end) over (partition by src) as target from by_abundance)
    where n = 1 or target is null or cnt * (1 - plus_frac) >= 0.1 * {FRACTION} * target)"""
_BALANCE = f"""{_GGT},
balanced as materialized (select src, node, flipped, nt, dst, cnt, plus_frac from (select *, count(*) over (partition by src) as n,
    bool_or(cnt >= {LOW_COUNT} and least(plus_frac, 1 - plus_frac) > 0.25) over (partition by src) as both_strands from by_ggt)
    where n = 1 or not both_strands or cnt <= 1 or least(plus_frac, 1 - plus_frac) >= 0.1 * {FRACTION} * greatest(plus_frac, 1 - plus_frac))"""
_UNIQUE = f"""{_BALANCE},
single as materialized (select src, any_value(dst) as dst from balanced group by src having count(*) = 1),
turned as (select {_RC.format('dst')} as src, {_RC.format('src')} as dst from single),
unique_edges as (select src, dst from single intersect select src, dst from turned)"""
_LENGTHS = "lengths as (select n_chars as length from documents where n_chars > 0), sorted as (select length, sum(length) over (order by length desc rows unbounded preceding) as up_to, row_number() over (order by length desc) as rank, sum(length) over () as total from lengths)"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.documents(spark, sf_dir)


def _kmers(spark: SparkSession, sf_dir: str, least: int = MIN_COUNT) -> DataFrame:
    return kmers.count_kmers(_reads(spark, sf_dir), K, least)


def _lettered(spark: SparkSession, sf_dir: str, least: int = MIN_COUNT) -> DataFrame:
    return kmers.lettered(_kmers(spark, sf_dir, least), K)


def _target_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's k-mers that targets have."""
    return kmers.count_kmers(_reads(spark, sf_dir), K, MIN_COUNT, kmers.explode_kmers(projection.targets(spark, sf_dir), K))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers that a query reads more than once."""
    return staged(_kmers(spark, sf_dir), "kmers")


def _forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.forks_of(_table(spark, sf_dir), K, LOW_COUNT)


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.filtered(_forks(spark, sf_dir), K, FRACTION, LOW_COUNT)


def _steps(forks: DataFrame) -> DataFrame:
    return kmers.lettered(graph.successors(forks, K).select("src", "dst", "cnt"), K, "src", "dst")


def _target_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.targets(spark, sf_dir).withColumnRenamed("target_id", "id")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("n_chars").alias("length"))


# K-mers.


@_query("kmer_count", f"with {_KMERS} select kmer, cnt, plus from kmers")
def kmer_count(spark, sf_dir):
    return _lettered(spark, sf_dir)


@_query("kmer_hist", f"with {_COUNTS} select cnt as count, count(*) as freq from counts group by cnt")
def kmer_hist(spark, sf_dir):
    return kmers.histogram(_kmers(spark, sf_dir, 1))


@_query("kmer_text", f"with {_KMERS} select kmer || chr(9) || cnt || chr(9) || plus as value from kmers order by kmer")
def kmer_text(spark, sf_dir):
    return sinks.kmer_lines(_lettered(spark, sf_dir))


@_query("histogram_text", f"with {_COUNTS} select cnt || chr(9) || count(*) as value from counts group by cnt order by cnt")
def histogram_text(spark, sf_dir):
    return sinks.histogram_lines(kmers.histogram(_kmers(spark, sf_dir, 1)))


@_query("min_count_filter", f"with {_COUNTS} select kmer, cnt from counts where cnt >= 5")
def min_count_filter(spark, sf_dir):
    return _lettered(spark, sf_dir, 5).select("kmer", "cnt")


@_query("canonical_orientation", f"with {_READS}, {_windows('kw', 'reads', 'read_id')} select read_id, count(*) as n_kmers, cast(sum(is_plus::int) as bigint) as n_plus from kw group by read_id")
def canonical_orientation(spark, sf_dir):
    rows = kmers.explode_kmers(_reads(spark, sf_dir), K, "read_id")
    return rows.groupBy("read_id").agg(F.count("*").alias("n_kmers"), F.sum(F.col("is_plus").cast("long")).alias("n_plus"))


@_query("plus_fraction", f"with {_KMERS} select kmer, cnt, plus, cast(floor(plus::double / cnt * 65535 + 0.5) as integer) as plus_q from kmers")
def plus_fraction(spark, sf_dir):
    return kmers.strand_fraction(_lettered(spark, sf_dir))


_ADAPTERS = f"{_READS}, {_windows('aw', 'reads', 'read_id', 19)}, adapters as (select kmer, count(*) as cnt from aw group by kmer having count(*) >= {ADAPTER_LIMIT} and count(*) > floor(0.05 * (select count(*) from reads)))"


@_query("adapter_kmers", f"with {_ADAPTERS} select kmer, cnt from adapters")
def adapter_kmers(spark, sf_dir):
    return kmers.lettered(kmers.adapter_kmers(_reads(spark, sf_dir), 0.05, ADAPTER_LIMIT), 19)


@_query("adapter_clip", f"with {_ADAPTERS}, hits as (select read_id, min(pos) as cut from aw join adapters using (kmer) group by read_id), clipped as (select read_id, case when cut is null then seq else substr(seq, 1, cut) end as seq from reads left join hits using (read_id)) select read_id, seq from clipped where seq <> ''")
def adapter_clip(spark, sf_dir):
    return kmers.clip_adapters(_reads(spark, sf_dir), 0.05, ADAPTER_LIMIT).select("read_id", "seq")


@_query("genome_size")
def genome_size(spark, sf_dir):
    return kmers.genome(kmers.histogram(_kmers(spark, sf_dir, 1)))


# Reads and scalar functions.


@_query("clean_reads", "with runs as (select page_id as read_id, unnest(string_split_regex(translate(html, 'acgt', 'ACGT'), '[^ACGT]+')) as run, generate_subscripts(string_split_regex(translate(html, 'acgt', 'ACGT'), '[^ACGT]+'), 1) as i from pages) select read_id, arg_min(run, (-length(run), i)) as seq from runs group by read_id having max(length(run)) > 0")
def clean_reads(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("read_id"), F.translate("html", "acgt", "ACGT").alias("seq"))
    return reads.clean(pages)


@_query("read_lengths", f"with {_READS} select read_id, cast(length(seq) as bigint) as length from reads where length(seq) > 0")
def read_lengths(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", F.length("seq").cast("long").alias("length")).where("length > 0")


@_query("revcomp", f"with {_READS} select read_id, {_RC.format('seq')} as rc from reads")
def revcomp(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", X.revcomp(F.col("seq")).alias("rc"))


_ENTROPY = " + ".join(f"-p{b} * ln(p{b}) / ln(4)" for b in "ACGT")
_PARTS = ", ".join(f"(length(seq) - length(replace(seq, '{b}', '')) + 1e-8) / length(seq) as p{b}" for b in "ACGT")


@_query("entropy", f"with {_READS}, parts as (select read_id, length(seq) as n, {_PARTS} from reads) select read_id, round(case when n > 0 then {_ENTROPY} else 0 end, 6) as entropy from parts")
def entropy(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", F.round(X.entropy(F.col("seq")), 6).alias("entropy"))


@_query("edit_distance", f"with {_TARGETS} select a.target_id, cast(levenshtein(a.seq, b.seq) as bigint) as distance from targets a join targets b on b.target_id = a.target_id + 1")
def edit_distance(spark, sf_dir):
    t = projection.targets(spark, sf_dir)
    following = t.select((F.col("target_id") - 1).alias("target_id"), F.col("seq").alias("next"))
    return t.join(following, "target_id").select("target_id", F.levenshtein("seq", "next").cast("long").alias("distance"))


_CODONS = [a + b + c for a in X.CODON_BASES for b in X.CODON_BASES for c in X.CODON_BASES]
_CODE = f"codons as (select unnest({_CODONS}) as codon, unnest(string_split('{X.STANDARD_CODE}', '')) as aa)"


def _proteins(frame_rows: str) -> str:
    return f"""with {_TARGETS}, {_CODE}, framed as ({frame_rows}),
parts as (select target_id, frame, unnest(range(0, length(s) // 3)) as i, s from framed),
aas as (select target_id, frame, i, coalesce(aa, 'X') as aa from parts left join codons on codon = substr(s, i * 3 + 1, 3)),
done as (select target_id, frame, string_agg(aa, '' order by i) as protein from aas group by target_id, frame)
select f.target_id, f.frame, coalesce(protein, '') as protein from framed f left join done d on d.target_id = f.target_id and d.frame = f.frame"""


@_query("translate", _proteins("select target_id, 1 as frame, seq as s from targets"))
def translate(spark, sf_dir):
    return projection.targets(spark, sf_dir).select("target_id", F.lit(1).alias("frame"), X.translate_codons(F.col("seq")).alias("protein"))


@_query("six_frame", _proteins(" union all ".join(f"select target_id, {s * (n + 1)} as frame, substr({'seq' if s > 0 else _RC.format('seq')}, {n + 1}) as s from targets" for s in (1, -1) for n in range(3))))
def six_frame(spark, sf_dir):
    return projection.targets(spark, sf_dir).select("target_id", F.explode(X.frames(F.col("seq"))).alias("f")).select("target_id", "f.frame", "f.protein")


@_query("mate_pairs", f"with {_MATES}, n as (select pair_id, sum((seq <> '')::int) as n from mates group by pair_id) select case when n = 2 then pair_id end as pair_id, case when n = 2 then mate else 0 end as mate, seq from mates join n using (pair_id) where seq <> ''")
def mate_pairs(spark, sf_dir):
    """All turns; mate 0: unpaired."""
    return reads.demote(projection.mates(spark, sf_dir)).select("pair_id", F.coalesce("mate", F.lit(0)).alias("mate"), "seq")


@_query(
    "pair_overlap",
    f"with {_MATES}, both_mates as (select pair_id, max(case when mate = 1 then seq end) as a, max(case when mate = 2 then {_RC.format('seq')} end) as b from mates group by pair_id), "
    "ns as (select pair_id, a, b, unnest(range(20, least(length(a), length(b)) + 1)) as n from both_mates where length(a) >= 20 and length(b) >= 20), "
    "hit as (select pair_id, max(n) as n from ns where right(a, n) = left(b, n) group by pair_id) "
    "select pair_id, coalesce(n, 0) as overlap from both_mates left join hit using (pair_id) where length(a) >= 20 and length(b) >= 20",
)
def pair_overlap(spark, sf_dir):
    return mapping.mate_overlaps(projection.mates(spark, sf_dir))


# Statistics.


@_query("stats_n50", f"with {_LENGTHS} select max(length) as n50 from sorted where up_to >= floor(total * 0.5)")
def stats_n50(spark, sf_dir):
    return stats.nxx(_lengths(spark, sf_dir), 0.5, "n50")


@_query("stats_n90", f"with {_LENGTHS} select max(length) as n90 from sorted where up_to >= floor(total * 0.9)")
def stats_n90(spark, sf_dir):
    return stats.nxx(_lengths(spark, sf_dir), 0.9, "n90")


@_query("stats_l50", f"with {_LENGTHS} select min(rank) as l50 from sorted where up_to >= floor(total * 0.5)")
def stats_l50(spark, sf_dir):
    return stats.lxx(_lengths(spark, sf_dir), 0.5, "l50")


@_query(
    "stats_report",
    f"with {_LENGTHS}, p as (select count(*) as sequences, cast(sum(length) as bigint) as total, max(length) as longest, min(length) as shortest, avg(length) as average from lengths) select p.*, "
    + ", ".join(f"(select max(length) from sorted s where up_to >= floor(s.total * {f})) as n{n}, (select min(rank) from sorted s where up_to >= floor(s.total * {f})) as l{n}" for f, n in ((0.5, 50), (0.9, 90)))
    + " from p",
)
def stats_report(spark, sf_dir):
    return stats.report(_lengths(spark, sf_dir))


# The graph.


@_query("edges", f"with {_EDGES} select src, nt, dst, cnt, round(plus_frac, 9) as plus_frac from edges")
def edges(spark, sf_dir):
    rows = graph.edges(_table(spark, sf_dir), K).select("src", "nt", "dst", "cnt", F.round("plus_frac", 9).alias("plus_frac"))
    return kmers.lettered(rows, K, "src", "dst")


@_query("branch_bits", f"with {_EDGES}, masks as (select node as kmer, bit_or(case when flipped then 16 << nt else 1 << nt end) as branch from edges group by node) select kmer, cast(coalesce(branch, 0) as integer) as branch from kmers left join masks using (kmer)")
def branch_bits(spark, sf_dir):
    return kmers.lettered(graph.branches(_table(spark, sf_dir), K), K)


@_query("fork_abundance_filter", f"with {_ABUNDANCE} select src, dst, cnt from by_abundance")
def fork_abundance_filter(spark, sf_dir):
    return _steps(graph.by_abundance(_forks(spark, sf_dir), FRACTION, LOW_COUNT))


@_query("fork_ggt", f"with {_GGT} select src, dst, cnt from by_ggt")
def fork_ggt(spark, sf_dir):
    return _steps(graph.by_ggt(graph.by_abundance(_forks(spark, sf_dir), FRACTION, LOW_COUNT), K, FRACTION))


@_query("strand_balance", f"with {_BALANCE} select src, dst, cnt from balanced")
def strand_balance(spark, sf_dir):
    return _steps(_balanced(spark, sf_dir))


@_query("successor_rank", f"with {_BALANCE} select src, dst, cast(row_number() over (partition by src order by cnt desc, nt) as integer) as rank from balanced")
def successor_rank(spark, sf_dir):
    return kmers.lettered(graph.ranked(_balanced(spark, sf_dir), K).select("src", "dst", "rank"), K, "src", "dst")


@_query("unique_edges", f"with {_UNIQUE} select src, dst from unique_edges")
def unique_edges(spark, sf_dir):
    return kmers.lettered(graph.unique_edges(_balanced(spark, sf_dir), K, together=True), K, "src", "dst")


@_query(
    "unitig_ends",
    f"with {_UNIQUE}, flags as (select b.src, p.dst is null as is_head, n.src is null as is_tail from (select distinct src from both_ways) b left join unique_edges n on n.src = b.src left join unique_edges p on p.dst = b.src) select src, is_head, is_tail from flags where is_head or is_tail",
)
def unitig_ends(spark, sf_dir):
    found = _table(spark, sf_dir)
    kept = staged(graph.unique_edges(graph.filtered(graph.forks_of(found, K, LOW_COUNT), K, FRACTION, LOW_COUNT), K, together=True), "unique-edges")
    return kmers.lettered(graph.ends(graph.oriented(found, K), kept), K, "src")


_WAYS = f"""{_GGT},
links as materialized (select b.src, b.dst, r.src is not null as back from by_abundance b left join by_abundance r on r.src = {_RC.format('b.dst')} and r.dst = {_RC.format('b.src')}),
tried as materialized (select src, dst from by_ggt where src in (select src from by_ggt group by src having count(*) > 1 and max(cnt) > 5)),
walks(start, node, depth) as (select distinct dst, dst, 0 from tried union select start, dst, depth + 1 from walks join links on src = node where depth < {graph.WAY_OUT} and (depth + 1 <> {K} or back)),
good as materialized (select distinct start from walks where depth = {graph.WAY_OUT})"""
_FULL = f"""{_WAYS},
alive as (select g.* from by_ggt g where not exists (select 1 from tried t where t.src = g.src and t.dst = g.dst) or g.dst in (select start from good)),
full_filter as (select src, nt, dst, cnt from (select *, count(*) over (partition by src) as n,
    bool_or(cnt >= {LOW_COUNT} and least(plus_frac, 1 - plus_frac) > 0.25) over (partition by src) as both_strands from alive)
    where n = 1 or not both_strands or cnt <= 1 or least(plus_frac, 1 - plus_frac) >= 0.1 * {FRACTION} * greatest(plus_frac, 1 - plus_frac))"""


@_query("fork_extendable", f"with recursive {_WAYS} select src, dst, dst in (select start from good) as extendable from tried")
def fork_extendable(spark, sf_dir):
    """Whether the successors of forks with a well supported one lead on for 100 steps."""
    found = _table(spark, sf_dir)
    whole = staged(graph.by_abundance(graph.forks_of(found, K, LOW_COUNT), FRACTION, LOW_COUNT), "forks")
    tried = staged(graph.successors(graph.contested(graph.by_ggt(whole, K, FRACTION)), K).select("src", "dst"), "tried")
    good = graph.with_way_out(tried.select(F.col("dst").alias("src")), whole, found, K).select(F.col("src").alias("dst"), F.lit(True).alias("extendable"))
    return kmers.lettered(tried.join(good, "dst", "left").select("src", "dst", F.coalesce("extendable", F.lit(False)).alias("extendable")), K, "src", "dst")


@_query("fork_full_filter", f"with recursive {_FULL} select src, dst, cnt from full_filter")
def fork_full_filter(spark, sf_dir):
    return _steps(graph.fully_filtered(_table(spark, sf_dir), K, FRACTION, LOW_COUNT))


@_query("unitigs")
def unitigs(spark, sf_dir):
    return contigs.unitigs(_table(spark, sf_dir), K, FRACTION, LOW_COUNT).select("seq", F.size("counts").alias("n_kmers"), "circular")


@_query("contigs")
def contig_sequences(spark, sf_dir):
    found = _table(spark, sf_dir)
    parts = contigs.directed(contigs.trimmed(contigs.unitigs(found, K, FRACTION, LOW_COUNT), K), K)
    return contigs.abundances(parts, found, K).select("seq", F.round("abundance", 9).alias("abundance"))


# Reads, targets and contigs against k-mers.

_PLACES = f"{_windows('tw', 'targets', 'target_id')}, places as (select kmer, min(target_id) as contig, min(pos) as contig_pos, bool_and(is_plus) as contig_plus from tw group by kmer having count(*) = 1)"
_PLACED = f"""{_READS}, {_TARGETS}, {_windows('rw', 'reads', 'read_id')}, {_PLACES},
hits as (select read_id, contig, contig_pos, contig_plus = is_plus as same, pos, row_number() over (partition by read_id order by pos) as n from rw join places using (kmer)),
placed as (select read_id, contig, case when same then 1 else -1 end as strand, case when same then contig_pos - pos else contig_pos + {K} - 1 + pos end as position from hits where n = 1)"""


@_query("read_placement", f"with {_PLACED} select read_id, contig, cast(strand as integer) as strand, cast(position as bigint) as position from placed")
def read_placement(spark, sf_dir):
    return mapping.place(_reads(spark, sf_dir), _target_contigs(spark, sf_dir), K)


@_query(
    "used_read_anti",
    f"with {_PLACED}, deep as (select read_id from placed join (select target_id as contig, length(seq) as clen from targets) using (contig) join (select read_id, length(seq) as rlen from reads) using (read_id) "
    f"where strand > 0 and position >= {MARGIN} and position + rlen - 1 < clen - {MARGIN} or strand < 0 and position - rlen + 1 >= {MARGIN} and position < clen - {MARGIN}) "
    f"select read_id from reads where length(seq) >= {K} and read_id not in (select read_id from deep)",
)
def used_read_anti(spark, sf_dir):
    return mapping.unused_reads(_reads(spark, sf_dir), _target_contigs(spark, sf_dir), K, MARGIN).select("read_id")


@_query(
    "longest_good_run",
    f"""with {_KMERS}, good as (select read_id, pos from kw where kmer in (select kmer from kmers)),
marks as (select read_id, pos, coalesce(pos - lag(pos) over (partition by read_id order by pos) > {K}, false)::int as fresh from good),
islands as (select read_id, pos, sum(fresh) over (partition by read_id order by pos) as island from marks),
runs as (select read_id, min(pos) as start, max(pos) - min(pos) + {K} as length from islands group by read_id, island),
best as (select *, row_number() over (partition by read_id order by length desc, start) as n from runs)
select read_id, cast(start as bigint) as start, cast(length as bigint) as length from best where n = 1""",
)
def longest_good_run(spark, sf_dir):
    return mapping.longest_counted_run(_reads(spark, sf_dir), K, LOW_COUNT)


@_query(
    "target_hits",
    f"with {_READS}, {_TARGETS}, {_windows('rw', 'reads', 'read_id')}, {_windows('tw', 'targets', 'target_id')}, a as (select read_id, kmer, count(*) as m from rw group by all), b as (select target_id, kmer, count(*) as n from tw group by all) select read_id, target_id, cast(sum(m * n) as bigint) as hits from a join b using (kmer) group by read_id, target_id",
)
def target_hits(spark, sf_dir):
    return mapping.target_hits(_reads(spark, sf_dir), projection.targets(spark, sf_dir), K)


@_query("target_seeds", f"with {_KMERS}, {_TARGETS}, {_windows('tw', 'targets', 'target_id')} select target_id, cast(pos as bigint) as pos, kmer, cnt from tw join kmers using (kmer)")
def target_seeds(spark, sf_dir):
    return kmers.lettered(mapping.target_seeds(projection.targets(spark, sf_dir), _target_kmers(spark, sf_dir), K), K)


@_query(
    "best_target_seed",
    f"with {_KMERS}, {_TARGETS}, {_windows('tw', 'targets', 'target_id')}, scored as (select target_id, pos, cnt, floor(cnt * 1000 / (abs(pos - length(seq) // 2) + 1)) as score from tw join kmers using (kmer) join targets using (target_id)), "
    "best as (select *, row_number() over (partition by target_id order by score desc, pos desc) as n from scored) select target_id, cast(pos as bigint) as pos, cnt from best where n = 1",
)
def best_target_seed(spark, sf_dir):
    found = mapping.best_seeds(projection.targets(spark, sf_dir), _target_kmers(spark, sf_dir), K)
    return found.select("target_id", F.col("pos").cast("long").alias("pos"), "cnt")


@_query("sequence_abundance", f"with {_KMERS}, {_TARGETS}, {_windows('tw', 'targets', 'target_id')} select target_id, round(sum(coalesce(cnt, 0)) / count(*), 9) as abundance from tw left join kmers using (kmer) group by target_id")
def sequence_abundance(spark, sf_dir):
    rows = contigs.abundances(projection.targets(spark, sf_dir), _target_kmers(spark, sf_dir), K, "target_id")
    return rows.select("target_id", F.round("abundance", 9).alias("abundance"))


@_query(
    "orient_min_kmer",
    f"with {_TARGETS}, ids as (select distinct seq from targets), {_windows('tw', 'ids', 'seq')}, once as (select seq, kmer, bool_and(is_plus) as is_plus from tw group by seq, kmer having count(*) = 1), "
    f"least_one as (select seq, arg_min(is_plus, {_ORD.format('kmer')}) as is_plus from once group by seq) select case when is_plus = false then {_RC.format('seq')} else seq end as seq from ids left join least_one using (seq)",
)
def orient_min_kmer(spark, sf_dir):
    return contigs.directed(projection.targets(spark, sf_dir).select("seq"), K)


@_query(
    "overlap_links",
    f"""with {_TARGETS}, strands as (select target_id as b, '+' as strand, seq as sb from targets union all select target_id, '-', {_RC.format('seq')} from targets),
pairs as (select a.target_id as a, b, strand, seq as sa, sb from targets a join strands on a.target_id <> b and (strand = '+' or a.target_id < b)),
ns as (select a, b, strand, sa, sb, unnest(range(20, least(length(sa), length(sb), 1000) + 1)) as n from pairs)
select a, b, strand, cast(max(n) as integer) as overlap from ns where right(sa, n) = left(sb, n) group by a, b, strand""",
)
def overlap_links(spark, sf_dir):
    return contigs.overlaps(_target_contigs(spark, sf_dir))


# Forks, bubbles and pairs.

REACH, BUBBLE, SPAN = 4, 2 * K, 100


@_query("read_n50", f"with {_READS}, l as (select length(seq) as n from reads where seq <> ''), s as (select n, sum(n) over (order by n desc rows unbounded preceding) as up_to, sum(n) over () as total from l) select cast(max(n) as bigint) as n50 from s where up_to >= floor(total * 0.5)")
def read_n50(spark, sf_dir):
    return stats.nxx(_reads(spark, sf_dir).select(F.length("seq").alias("length")), 0.5, "n50")


@_query(
    "bounded_bfs",
    f"with recursive {_BALANCE}, links as materialized (select distinct src, dst from balanced), forked as (select src from links group by src having count(*) > 1), "
    f"reach(start, node, depth) as (select src, dst, 1 from links join forked using (src) union select start, dst, depth + 1 from reach join links on src = node where depth < {REACH}) "
    "select start, node, cast(min(depth) as integer) as depth from reach group by start, node",
)
def bounded_bfs(spark, sf_dir):
    steps = staged(graph.successors(_balanced(spark, sf_dir), K).select("src", "dst"), "steps")
    return kmers.lettered(graph.reachable(graph.forking(steps), steps, REACH), K, "start", "node")


@_query("snp_bubbles")
def snp_bubbles(spark, sf_dir):
    found = contigs.bubbles(_table(spark, sf_dir), K, BUBBLE, FRACTION, LOW_COUNT)
    return found.select("src", "close", F.array_join("variants", ",").alias("variants"))


@_query(
    "pair_classes",
    f"""with {_MATES}, {_TARGETS}, {_windows('rw', 'mates', 'pair_id, mate')}, {_PLACES},
hits as (select pair_id, mate, contig, contig_pos, contig_plus = is_plus as same, pos, row_number() over (partition by pair_id, mate order by pos) as n from rw join places using (kmer)),
placed as (select pair_id, mate, contig, t.seq as cseq, length(t.seq) as clen, case when same then 1 else -1 end as strand, case when same then contig_pos - pos else contig_pos + {K} - 1 + pos end as p
    from hits join targets t on t.target_id = contig where n = 1),
deep as (select distinct pair_id from placed where strand > 0 and p >= {MARGIN} and p + {SPAN} - 1 < clen - {MARGIN} or strand < 0 and p - {SPAN} + 1 >= {MARGIN} and p < clen - {MARGIN}),
facing as (select a.pair_id, a.cseq, a.clen, case when a.strand > 0 then a.p else b.p end as low, case when a.strand > 0 then b.p else a.p end as high, least(a.p, b.p) as s, greatest(a.p, b.p) as e
    from placed a join placed b on a.pair_id = b.pair_id and a.mate = 1 and b.mate = 2 and a.contig = b.contig and a.strand <> b.strand),
both_mates as (select pair_id, min(length(seq)) as shortest from mates group by pair_id having count(*) = 2),
fates as (select m.pair_id, cseq, clen, s, e, case when shortest < {K} then 'kept' when d.pair_id is not null or low >= {MARGIN} and high < clen - {MARGIN} then 'deep' when low >= 0 and high < clen then 'internal' else 'kept' end as fate
    from both_mates m left join deep d on d.pair_id = m.pair_id left join facing f on f.pair_id = m.pair_id)
select pair_id, fate, case when fate = 'internal' then substr(cseq, greatest(s, 0) + 1, least(e, clen - 1) - greatest(s, 0) + 1) end as seq from fates""",
)
def pair_classes(spark, sf_dir):
    return mapping.classify_pairs(projection.mates(spark, sf_dir), _target_contigs(spark, sf_dir), K, MARGIN, SPAN)


# Contigs against the graph of the reads.

KS = (21, 31)
_BY_K = ", ".join(_windows(f"w{k}", "reads", "read_id", k) for k in KS)
_HISTS = " union all ".join(f"select {k} as k, cnt, count(*) as freq from (select kmer, count(*) as cnt from w{k} group by kmer) group by cnt" for k in KS)


@_query("graph_histograms", f"with {_READS}, {_BY_K}, hists as ({_HISTS}) select concat_ws(chr(9), k, cnt, freq) as value from hists")
def graph_histograms(spark, sf_dir):
    return sinks.graph_histogram_lines({k: kmers.histogram(kmers.count_kmers(_reads(spark, sf_dir), k)) for k in KS})


@_query(
    "node_states",
    f"with {_KMERS}, {_TARGETS}, {_windows('tw', 'targets', 'target_id')}, held as (select kmer, case when count(*) > 1 then 3 else 1 end as state from tw group by kmer) "
    "select kmer, cast(coalesce(state, 0) as integer) as state from kmers left join held using (kmer)",
)
def node_states(spark, sf_dir):
    return kmers.lettered(contigs.node_states(_kmers(spark, sf_dir), projection.targets(spark, sf_dir), K), K)


@_query("seed_survival", f"with {_KMERS}, {_TARGETS}, {_windows('tw', 'targets', 'target_id')} select target_id from tw left join kmers using (kmer) group by target_id having sum(coalesce(cnt, 0)) >= {LOW_COUNT} * count(*) union all select target_id from targets where length(seq) < {K}")
def seed_survival(spark, sf_dir):
    return contigs.surviving_seeds(projection.targets(spark, sf_dir), _target_kmers(spark, sf_dir), K, LOW_COUNT, "target_id")


@_query(
    "variant_scores",
    f"""with {_KMERS}, {_TARGETS}, changed as (select target_id, base as text, right(left(seq, length(seq) // 2), {K - 1}) || base || left(substr(seq, length(seq) // 2 + 2), {K - 1}) as seq from targets cross join (select unnest(['A', 'C', 'G', 'T']) as base) where seq <> ''),
{_windows('vw', 'changed', 'target_id, text')}, sums as (select target_id, text, sum(cnt) as n from vw join kmers using (kmer) group by all),
shares as (select target_id, text, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by target_id) as total from changed left join sums using (target_id, text))
select target_id, text, round(case when total > 0 then n / total else 0 end, 9) as score, cast(row_number() over (partition by target_id order by n desc, text desc) as integer) as rank from shares""",
)
def variant_scores(spark, sf_dir):
    """The base in the middle of each target against the other three."""
    mid = F.floor(F.length("seq") / 2).cast("int")
    rows = projection.targets(spark, sf_dir).where("seq <> ''").select(F.col("target_id").alias("id"), F.substr("seq", F.lit(1), mid).alias("before"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("text"), F.substr("seq", mid + 2).alias("after"))
    return contigs.variant_scores(rows, _kmers(spark, sf_dir), K).select(F.col("id").alias("target_id"), "text", F.round("score", 9).alias("score"), "rank")


@_query("kmers_outside", f"with {_KMERS}, {_TARGETS}, {_windows('tw', 'targets', 'target_id')} select kmer, cnt from kmers where kmer not in (select kmer from tw)")
def kmers_outside(spark, sf_dir):
    return kmers.lettered(contigs.kmers_outside(_kmers(spark, sf_dir), projection.targets(spark, sf_dir), K).select("kmer", "cnt"), K)


# Chunks, records and paths between nodes.


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, chunks: a target with three variants of its middle base, which differ in length."""
    mid = F.floor(F.length("seq") / 2).cast("int")
    plain = lambda c: F.array(c)
    parts = F.array(plain(F.substr("seq", F.lit(1), mid)), F.array(*map(F.lit, ("A", "CC", "GTG"))), plain(F.substr("seq", mid + 2)))
    return projection.targets(spark, sf_dir).where("seq <> ''").select("target_id", parts.alias("chunks"))


_CHUNKED = f"{_TARGETS}, halves as (select target_id, left(seq, length(seq) // 2) as a, substr(seq, length(seq) // 2 + 2) as b from targets where seq <> '')"


@_query("chunk_lengths", f"with {_CHUNKED} select target_id, length(a) + length(b) + 1 as len_min, length(a) + length(b) + 3 as len_max, {_RC.format('b')} || 'T' || {_RC.format('a')} as turned from halves")
def chunk_lengths(spark, sf_dir):
    c = F.col("chunks")
    return _chunked(spark, sf_dir).select("target_id", chunks.length_min(c).alias("len_min"), chunks.length_max(c).alias("len_max"), chunks.primary(chunks.reversed_chunks(c)).alias("turned"))


@_query("expanded_variants", f"with {_CHUNKED} select target_id, a || unnest(['A', 'CC', 'GTG']) || b as seq from halves")
def expanded_variants(spark, sf_dir):
    return _chunked(spark, sf_dir).select("target_id", F.explode(chunks.expanded(F.col("chunks"))).alias("seq"))


@_query(
    "start_stop_codons",
    f"with {_TARGETS}, cut as (select target_id, unnest(list_transform(range(0, length(seq) // 3), lambda i: substr(seq, i * 3 + 1, 3))) as c from targets) "
    "select target_id, count(c) filter (c in ('TTG', 'CTG', 'ATG')) as n_starts, count(c) filter (c in ('TAA', 'TAG', 'TGA')) as n_stops from targets left join cut using (target_id) group by target_id",
)
def start_stop_codons(spark, sf_dir):
    found = projection.targets(spark, sf_dir).select("target_id", X.codons(F.col("seq")).alias("c"))
    return found.select("target_id", F.size(F.filter("c", X.is_start)).cast("long").alias("n_starts"), F.size(F.filter("c", X.is_stop)).cast("long").alias("n_stops"))


@_query("contig_records", f"with {_TARGETS} select '>Contig_' || row_number() over (order by seq) || '_0' || chr(10) || seq as value from (select distinct seq from targets where length(seq) >= 200)")
def contig_records(spark, sf_dir):
    rows = projection.targets(spark, sf_dir).where("length(seq) >= 200").select("seq").distinct()
    return sinks.plain_contig_fasta(ranked_rows(rows, "number", "seq"))


PATH_STEPS = 4


@_query(
    "unique_paths",
    f"""with recursive {_ABUNDANCE}, links as materialized (select src, dst, substr('ACTG', nt + 1, 1) as base from by_abundance), forked as (select src from links group by src having count(*) > 1),
walks(start, node, path, depth) as (select src, dst, base, 1 from links join forked using (src) union all select start, dst, path || base, depth + 1 from walks join links on src = node where depth < {PATH_STEPS}),
placed as (select start, {_canon('node')} as node, path, depth from walks), goals as (select distinct start, node as goal from placed where depth = {PATH_STEPS - 1}),
hits as (select g.start, goal, path, depth, min(depth) over (partition by g.start, goal) as first from goals g join placed p on p.start = g.start and p.node = goal)
select start, goal, max(path) as path from hits where depth = first group by start, goal having count(*) = 1""",
)
def unique_paths(spark, sf_dir):
    """From each fork to the nodes three steps on."""
    whole = staged(graph.by_abundance(_forks(spark, sf_dir), FRACTION, LOW_COUNT), "forks")
    several = graph.successors(whole.where(graph.several()), K)
    at = staged(several.select(F.col("src").alias("start"), F.col("src").alias("node")).distinct(), "starts")
    steps = graph.near(at.select(F.col("node").alias("src")), graph.successors(whole, K).select("src", "dst"), PATH_STEPS - 1)
    for _ in range(PATH_STEPS - 1):
        at = at.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"))
    pairs = at.select("start", kmers.Packing(K).canonical(F.col("node")).alias("goal")).distinct()
    return kmers.lettered(graph.unique_paths(pairs, whole, K, PATH_STEPS), K, "start", "goal")


# Pairs through the graph. The pairs are the ends of fragments that the documents are cut into.

FRAGMENT, MATE, SAMPLE = 300, 100, 500
_FRAGMENTS = f"""cut_at as (select read_id, seq, unnest(range(0, length(seq) // {FRAGMENT})) as i from reads),
mated as materialized (select read_id || ':' || i as pair_id, substr(seq, i * {FRAGMENT} + 1, {MATE}) as a, substr(seq, i * {FRAGMENT} + {FRAGMENT - MATE} + 1, {MATE}) as b from cut_at)"""
_PAIR_STEPS = f"""{_EDGES},
by_share as (select src, node, flipped, nt, dst, cnt, plus_frac from (select *, sum(cnt) over (partition by src) as total, row_number() over (partition by src order by cnt desc, right(dst, 1)) as place from edges)
    where place = 1 or cnt > {FRACTION} * total),
shared_ggt as (select src, node, flipped, nt, dst, cnt, plus_frac from (select *, count(*) over (partition by src) as n,
    max(case when ends_with(dst, 'GGT') and cnt > 5 then cnt * (1 - plus_frac) end) over (partition by src) as target from by_share)
    where n = 1 or target is null or cnt * (1 - plus_frac) >= 0.1 * {FRACTION} * target),
likely as materialized (select src, dst from (select src, dst, row_number() over (partition by src order by cnt desc, right(dst, 1)) as place from edges) where place = 1),
likely_c as (select src, dst from likely where right(dst, 1) = 'C'),
on_cc as (select a.src from likely_c a join likely_c b on a.dst = b.src),
shared_acc as (select src, node, flipped, nt, dst, cnt, plus_frac from (select x.*, count(*) over (partition by x.src) as n,
    max(case when right(dst, 1) = 'A' and cnt > 5 and on_cc.src is not null then cnt * plus_frac end) over (partition by x.src) as target from shared_ggt x left join on_cc on x.dst = on_cc.src)
    where n = 1 or target is null or cnt * plus_frac >= 0.1 * {FRACTION} * target),
pair_steps as materialized (select src, dst, cnt from (select *, count(*) over (partition by src) as n,
    bool_or(cnt >= {LOW_COUNT} and least(plus_frac, 1 - plus_frac) > 0.25) over (partition by src) as both_strands from shared_acc)
    where n = 1 or not both_strands or cnt <= 1 or least(plus_frac, 1 - plus_frac) >= 0.1 * {FRACTION} * greatest(plus_frac, 1 - plus_frac))"""


def _extended_sql(name: str, source: str, steps: str) -> str:
    """CTEs; `name`: id, seq and before of source (id, seq) with up to K bases more on both ends, as steps (src, dst) lead."""
    return f"""{name}_walk as (select id, false as is_left, right(seq, {K}) as node, '' as added from {source} where length(seq) >= {K} union all
    select id, true, {_RC.format(f'left(seq, {K})')}, '' from {source} where length(seq) >= {K} union all
    select id, is_left, dst, added || right(dst, 1) from {name}_walk join {steps} on src = node where length(added) < {K}),
{name}_ends as (select id, {_RC.format("max(case when is_left then added end)")} as l, max(case when not is_left then added end) as r
    from (select id, is_left, arg_max(added, length(added)) as added from {name}_walk group by id, is_left) group by id),
{name} as materialized (select id, coalesce(l, '') || seq || coalesce(r, '') as seq, length(coalesce(l, '')) as before from {source} left join {name}_ends using (id))"""


_CLIPPED = f"""{_PAIR_STEPS}, {_FRAGMENTS},
oriented_mates as materialized (select pair_id || '/1' as id, a as seq from mated union all select pair_id || '/2', b from mated),
{_extended_sql('longer', 'oriented_mates', 'likely')},
longer_words as (select id, before, seq, unnest(range(0, length(seq) - {K})) as pos from longer),
longer_steps as (select id, before, pos, substr(seq, pos + 1, {K}) as x, substr(seq, pos + 2, {K}) as y from longer_words),
supported as (select id, pos + {K} - before as base_at, 1 as side from longer_steps join pair_steps on src = x and dst = y union all
    select id, pos - before, 2 from longer_steps join pair_steps on src = {_RC.format('y')} and dst = {_RC.format('x')}),
both_sides as (select id, base_at from supported where base_at between 0 and {MATE - 1} group by id, base_at having count(distinct side) = 2),
islands as (select id, min(base_at) as start, count(*) as n from (select id, base_at, base_at - row_number() over (partition by id order by base_at) as island from both_sides) group by id, island),
clipped as materialized (select id, start, substr(seq, start + 1, n) as seq from (select *, row_number() over (partition by id order by n desc, start) as place from islands) join oriented_mates using (id) where place = 1 and n >= {K})"""
_SEARCHED = f"""{_CLIPPED},
clipped_pairs as materialized (select x.id[:-3] as pair_id, x.seq as r1, y.seq as r2, instr(y.seq, right(x.seq, {K})) - 1 as hit from clipped x join clipped y on ends_with(x.id, '/1') and y.id = x.id[:-3] || '/2'),
overlapping as materialized (select *, hit >= 0 and hit < least(length(r1), length(r2)) - {K} + 1 and right(r1, hit + {K}) = left(r2, hit + {K}) as laps from clipped_pairs),
searches as materialized (select 'ring:' || pair_id as id, right(r1, {K}) as start, right(r1, {K}) as goal from overlapping where laps union all
    select 'ahead:' || pair_id, right(r1, {K}), left(r2, {K}) from overlapping where not laps union all
    select 'back:' || pair_id, {_RC.format(f'left(r2, {K})')}, {_RC.format(f'right(r1, {K})')} from overlapping where not laps),
levels as (select id, dst as node, 1 as depth, 1 as n from searches join pair_steps on src = start union all
    select id, dst, depth + 1, cast(least(2, sum(n)) as integer) from levels join pair_steps on src = node where depth < {pairs.MOST_STEPS} group by id, dst, depth),
crowded as (select id, min(depth) as crowd from (select id, depth from levels where depth > 1 group by id, depth having count(*) > {pairs.MOST_NODES}) group by id),
arrived as (select id, depth, sum(n) over (partition by id order by depth) as n from levels join searches using (id) where node = goal and depth > 1),
outcome as materialized (select s.id, case when t is not null and (crowd is null or t <= crowd) then 'ambiguous' when crowd is null and o is not null then 'one' else 'none' end as result, o as once
    from searches s left join (select id, min(depth) filter (where n > 1) as t, min(depth) filter (where n = 1) as o from arrived group by id) using (id) left join crowded using (id)),
short_levels as materialized (select l.id, l.node, l.depth from levels l join outcome o on l.id = o.id and result = 'one' and l.depth < once),
backwards as (select id, goal as node, once as depth, right(goal, 1) as path from outcome join searches using (id) where result = 'one' union all
    select b.id, l.node, l.depth, right(l.node, 1) || b.path from backwards b join short_levels l on l.id = b.id and l.depth = b.depth - 1 join pair_steps on src = l.node and dst = b.node),
found as (select id, result, path from outcome left join (select id, path from backwards where depth = 1) using (id)),
fates as materialized (select p.pair_id, r1, r2, laps, case when laps then (case when ring.result = 'none' then r1 || substr(r2, hit + {K + 1}) end)
    when ahead.result = 'one' and back.result = 'one' and r1 || ahead.path || substr(r2, {K + 1}) = left(r1, length(r1) - {K}) || {_RC.format('back.path')} || r2 then r1 || ahead.path || substr(r2, {K + 1}) end as seq,
    coalesce(ahead.result = 'none', false) as lost from overlapping p left join found ring on ring.id = 'ring:' || p.pair_id left join found ahead on ahead.id = 'ahead:' || p.pair_id left join found back on back.id = 'back:' || p.pair_id),
fated as materialized (select *, case when seq is not null then 'connected' when lost then 'none' else 'ambiguous' end as fate from fates)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(projection.fragments(spark, sf_dir, FRAGMENT, MATE), "fragments")


@_query("pair_steps", f"with {_PAIR_STEPS} select src, dst, cnt from pair_steps")
def pair_steps(spark, sf_dir):
    return _steps(pairs.pair_forks(_table(spark, sf_dir), K, FRACTION, LOW_COUNT)[1])


@_query("clip_for_pairing", f"with recursive {_CLIPPED} select id, cast(start as integer) as start, seq from clipped")
def clip_for_pairing(spark, sf_dir):
    whole, forks = pairs.pair_forks(_table(spark, sf_dir), K, FRACTION, LOW_COUNT)
    mates = _pairs(spark, sf_dir).select(F.concat_ws("/", "pair_id", "mate").alias("id"), F.when(F.col("mate") == 2, X.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    return pairs.clipped(mates, whole, forks, K, "id")


@_query(
    "connected_pairs",
    f"with recursive {_SEARCHED}, single_steps as (select src, any_value(dst) as dst from pair_steps group by src having count(*) = 1), "
    f"unclear as (select pair_id || '/1' as id, r1 as seq from fated where fate = 'ambiguous' union all select pair_id || '/2', r2 from fated where fate = 'ambiguous'), {_extended_sql('further', 'unclear', 'single_steps')} "
    f"select pair_id, fate, f.seq, left(x.seq, x.before) || r1 as mate1, {_RC.format('(r2 || substr(y.seq, y.before + length(r2) + 1))')} as mate2 from fated f left join further x on x.id = pair_id || '/1' left join further y on y.id = pair_id || '/2'",
)
def connected_pairs(spark, sf_dir):
    return pairs.connect(_pairs(spark, sf_dir), _table(spark, sf_dir), K, FRACTION, LOW_COUNT)


@_query("extended_reads", f"with recursive {_PAIR_STEPS}, {_FRAGMENTS}, single_steps as materialized (select src, any_value(dst) as dst from pair_steps group by src having count(*) = 1), first_mates as (select pair_id as id, a as seq from mated), {_extended_sql('further', 'first_mates', 'single_steps')} select id, seq, cast(before as integer) as before from further")
def extended_reads(spark, sf_dir):
    forks = pairs.pair_forks(_table(spark, sf_dir), K, FRACTION, LOW_COUNT)[1]
    first = _pairs(spark, sf_dir).where("mate = 1").select(F.col("pair_id").alias("id"), "seq")
    return pairs.extended(first, pairs.single_steps(forks, K), K, "id")


_DRAWN = f"""{_READS}, {_FRAGMENTS}, whole as (select count(*) as total from mated),
draw as (select 1 as i, cast({pairs.MULTIPLIER} as bigint) as x union all select i + 1, x * {pairs.MULTIPLIER} % {pairs.MODULUS} from draw where i < {8 * SAMPLE}),
drawn as (select (x - 1) // ({pairs.MODULUS - 2} // total) as place, min(i) as i from draw, whole where x - 1 < total * ({pairs.MODULUS - 2} // total) group by all order by i limit {SAMPLE}),
chosen as materialized (select pair_id from (select pair_id, row_number() over (order by pair_id) - 1 as place, total from mated, whole) where total <= {2 * SAMPLE} or place in (select place from drawn))"""


@_query("pair_sample", f"with recursive {_DRAWN} select pair_id from chosen")
def pair_sample(spark, sf_dir):
    return pairs.sampled(_pairs(spark, sf_dir), SAMPLE).select("pair_id").distinct()


@_query("insert_n50", f"with recursive {_SEARCHED}, {_DRAWN[_DRAWN.index('whole as'):]}, lengths as (select length(seq) as length from fated join chosen using (pair_id) where fate = 'connected'), walked as (select length, sum(length) over (order by length desc rows unbounded preceding) as up_to, sum(length) over () as total from lengths) select coalesce(max(length), 0) as insert_size from walked where 2 * up_to >= total")
def insert_n50(spark, sf_dir):
    return pairs.insert_size(_pairs(spark, sf_dir), _table(spark, sf_dir), K, SAMPLE, FRACTION, LOW_COUNT)


# Graphs of contigs. The contigs are windows of the documents that overlap by BORDER bases.

BORDER = 40
_LINKS = f"""{_READS}, window_at as (select read_id, seq, unnest(range(0, (length(seq) - {BORDER}) // {FRAGMENT - BORDER})) as i from reads where length(seq) > {BORDER}),
pieces as materialized (select seq, min(read_id * 100000 + i) as id from (select read_id, i, substr(seq, i * {FRAGMENT - BORDER} + 1, {FRAGMENT}) as seq from window_at) group by seq),
links as materialized (select distinct a.id as "left", b.id as "right" from pieces a join pieces b on right(a.seq, {BORDER}) = left(b.seq, {BORDER}) and a.id <> b.id)"""
_WAYS = f"""{_LINKS}, ways as (select "left" as start, "right" as "end", ["right"] as way from links union all
    select start, l."right", list_append(way, l."right") from ways join links l on "end" = l."left" where len(way) < {contig_graph.MOST_STEPS} and l."right" <> start and not list_contains(way, l."right")),
several as (select start, "end" from ways group by all having count(*) > 1), parted as materialized (select * from ways join several using (start, "end"))"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = FRAGMENT - BORDER
    rows = _reads(spark, sf_dir).withColumn("n", F.floor((F.length("seq") - BORDER) / step).cast("int")).where("n > 0")
    rows = rows.select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    rows = rows.select((F.col("read_id") * 100000 + F.col("i")).alias("id"), F.substr("seq", F.col("i") * step + 1, F.lit(FRAGMENT)).alias("seq"))
    return rows.groupBy("seq").agg(F.min("id").alias("id"))


@_query("contig_links", f'with {_LINKS} select "left", "right" from links')
def contig_links(spark, sf_dir):
    return contig_graph.bordering(staged(_pieces(spark, sf_dir), "pieces"), BORDER)


@_query("contig_cycles", f'with recursive {_LINKS}, reach as (select "left" as a, "right" as b from links union select a, "right" from reach join links on b = "left") select x.a as node, min(x.b) as cycle from reach x join reach y on x.a = y.b and x.b = y.a group by x.a')
def contig_cycles(spark, sf_dir):
    return contig_graph.cycles(contig_links(spark, sf_dir))


@_query("contig_bubbles", f"""with recursive {_WAYS} select start, "end", string_agg(array_to_string(way, '>'), '|' order by len(way), way) as ways from parted group by start, "end\"""")
def contig_bubbles(spark, sf_dir):
    found = contig_graph.bubbles(contig_links(spark, sf_dir))
    return found.withColumn("ways", F.array_join(F.transform("ways", lambda w: F.array_join(w.cast("array<string>"), ">")), "|"))


@_query(
    "contig_collapsed",
    f"""with recursive {_WAYS}, totals as (select start, "end", way, sum(coalesce(length(seq), 0)) as total from (select start, "end", way, unnest(way) as id from parted) left join pieces using (id) group by all),
best as (select start, "end", way as best from (select *, row_number() over (partition by start, "end" order by total desc, len(way) desc, way desc) as n from totals) where n = 1),
lesser as (select * from parted join best using (start, "end") where way <> best),
lost as (select unnest(way[:-2]) as "left", unnest(way[2:]) as "right" from lesser union select start, way[1] from lesser where way[1] <> best[1])
select "left", "right" from links except select "left", "right" from lost""",
)
def contig_collapsed(spark, sf_dir):
    pieces = staged(_pieces(spark, sf_dir), "pieces")
    return contig_graph.collapsed(staged(contig_graph.bordering(pieces, BORDER), "links"), pieces.select("id", F.length("seq").alias("length")))


REPEAT = 80


@_query(
    "repeat_margins",
    f"""with {_UNIQUE}, window_at as (select read_id, seq, unnest(range(0, (length(seq) - {BORDER}) // {FRAGMENT - BORDER})) as i from reads where length(seq) > {BORDER}),
pieces as materialized (select seq, min(read_id * 100000 + i) as id from (select read_id, i, substr(seq, i * {FRAGMENT - BORDER} + 1, {FRAGMENT}) as seq from window_at) group by seq),
tried as (select id, seq, unnest(range(0, {REPEAT - K + 1})) as p from pieces where length(seq) > {REPEAT}),
lefts as (select id, max(p) as bad from tried left join single on src = substr(seq, p + 1, {K}) and dst = substr(seq, p + 2, {K}) where src is null group by id),
rights as (select id, min(length(seq) - {REPEAT} + p) as bad from tried left join single on src = {_RC.format(f'substr(seq, length(seq) - {REPEAT} + p + 1, {K})')} and dst = {_RC.format(f'substr(seq, length(seq) - {REPEAT} + p, {K})')} where src is null group by id)
select p.id, cast(case when length(seq) > {REPEAT} then coalesce(l.bad + {K}, {K - 1}) else {REPEAT} end as integer) as left_repeat, cast(case when length(seq) > {REPEAT} then coalesce(length(seq) - r.bad, {K - 1}) else {REPEAT} end as integer) as right_repeat
from pieces p left join lefts l using (id) left join rights r using (id)""",
)
def repeat_margins(spark, sf_dir):
    margin = F.lit(REPEAT)
    pieces = staged(_pieces(spark, sf_dir).withColumns({"left_repeat": margin, "right_repeat": margin}), "pieces")
    return pairs.repeat_margins(pieces, staged(_balanced(spark, sf_dir), "balanced"), K)


# Variations along contigs, and table functions.


@_query(
    "variant_places",
    f"with {_TARGETS}, cut as (select target_id as number, seq, unnest(range(1, length(seq) // 50)) as j from targets where length(seq) >= 100) "
    "select number, cast(2 * j - 1 as integer) as i, cast(50 * j + j - 1 as integer) as start, substr(seq, 50 * j - 49, 50) as before, case when j = length(seq) // 50 - 1 then substr(seq, 50 * j + 1) else substr(seq, 50 * j + 1, 50) end as after from cut",
)
def variant_places(spark, sf_dir):
    """Targets cut every 50 bases, with a variation at each cut."""
    n = F.floor(F.length("seq") / 50).cast("int")
    part = lambda j: F.array(F.when(j == n - 1, F.substr("seq", j * 50 + 1)).otherwise(F.substr("seq", j * 50 + 1, F.lit(50))))
    between = F.array(*map(F.lit, ("A", "CC", "GTG")))
    made = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(j == n - 1, F.array(part(j))).otherwise(F.array(part(j), between))))
    rows = projection.targets(spark, sf_dir).where(F.length("seq") >= 100).select(F.col("target_id").alias("number"), made.alias("chunks"))
    return chunks.placed(rows).select("number", "i", "start", "before", "after")


@_query("kmers_by_sql", f"with {_TARGETS}, {_windows('tw', 'targets', 'target_id')} select target_id, cast(pos as integer) as pos, kmer, is_plus from tw")
def kmers_by_sql(spark, sf_dir):
    tables.register(spark)
    projection.targets(spark, sf_dir).createOrReplaceTempView("projected_targets")
    return spark.sql(f"select target_id, k.pos, k.kmer, k.is_plus from projected_targets, lateral kmers_of(seq, {K}) k")


@_query("frames_by_sql", ORACLE_SQL["six_frame"])
def frames_by_sql(spark, sf_dir):
    tables.register(spark)
    projection.targets(spark, sf_dir).createOrReplaceTempView("projected_targets")
    return spark.sql("select target_id, f.frame, f.protein from projected_targets, lateral frames_of(seq) f")


@_query(
    "denied_chains",
    f"""with recursive {_LINKS}, nexts as materialized (select a.id, min(b.id) as "to" from pieces a join pieces b on right(a.seq, {BORDER}) = left(b.seq, {BORDER}) group by a.id, right(a.seq, {BORDER})),
onward as materialized (select id, "to" from nexts where id <> "to"),
led as (select id as first, id as node, 0 as step from pieces union all select first, "to", step + 1 from led join onward on node = id where "to" <> first and step < 1000),
owned as (select node, first, step from (select *, row_number() over (partition by node order by first, step) as n from led) where n = 1)
select first as id, string_agg(case when step = 0 then seq else substr(seq, {BORDER + 1}) end, '' order by step) as seq, count(*) as n_parts from owned join pieces on node = id group by first""",
)
def denied_chains(spark, sf_dir):
    pieces = staged(_pieces(spark, sf_dir).withColumns({"left_end": F.left("seq", F.lit(BORDER)), "right_end": F.right("seq", F.lit(BORDER))}), "pieces")
    return contig_graph.chained(pieces, BORDER).select("id", "seq", F.size("parts").cast("long").alias("n_parts"))


SHORTEST, LONGEST = 30, 60
_OVERLAPPING = f"""{_LINKS[:_LINKS.index("links as materialized")]}strands as (select id as b, '+' as strand, seq as sb from pieces union all select id, '-', {_RC.format('seq')} from pieces),
ns as (select unnest(range({SHORTEST}, {LONGEST + 1})) as n),
suffixes as (select id as a, n, right(seq, n) as s from pieces, ns where length(seq) >= n), prefixes as (select b, strand, n, left(sb, n) as s from strands, ns where length(sb) >= n),
overlapping as (select a, b, strand, max(n) as overlap from suffixes join prefixes using (n, s) where a <> b and (strand = '+' or a < b) group by a, b, strand)"""


@_query("piece_overlaps", f"with {_OVERLAPPING} select a, b, strand, cast(overlap as integer) as overlap from overlapping")
def piece_overlaps(spark, sf_dir):
    return contigs.overlaps(staged(_pieces(spark, sf_dir), "pieces"), SHORTEST, LONGEST).select("a", "b", "strand", F.col("overlap").cast("int").alias("overlap"))


@_query(
    "piece_gfa",
    f"with {_OVERLAPPING} select 'H' || chr(9) || 'VN:Z:1.0' as value union all select concat_ws(chr(9), 'S', 'Contig_' || id, seq, 'LN:i:' || length(seq)) from pieces union all select concat_ws(chr(9), 'L', 'Contig_' || a, '+', 'Contig_' || b, strand, overlap || 'M') from overlapping",
)
def piece_gfa(spark, sf_dir):
    pieces = staged(_pieces(spark, sf_dir), "pieces")
    return sinks.gfa(pieces, contigs.overlaps(pieces, SHORTEST, LONGEST))
