"""Queries of this subpackage: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import RULES, judge_urls

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed_words

    return removed_words(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import encode

    return encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search_all

    return search_all(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _lloyd_sql() -> str:
    """Each round of Lloyd's as two expressions, the nearest entries and the moved ones."""
    rounds = []
    for i in range(5):
        rounds.append(
            f"""near{i} as materialized (select vec_id, pos, p, arg_min(e, d * 256 + e) as e, min(d) as d from (select parts.*, e, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from parts join book{i} using (pos)) group by vec_id, pos, p)"""
        )
        if i < 4:
            rounds.append(
                f"""book{i + 1} as materialized (select pos, e, coalesce(moved.c, old.c) as c from book{i} old left join (select pos, e, list(x order by j) as c
    from (select pos, e, j, cast(floor(sum(x) / count(*)) as bigint) as x from (select pos, e, unnest(p) as x, generate_subscripts(p, 1) as j from near{i}) group by pos, e, j) group by pos, e) moved using (pos, e))"""
            )
    return """
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, pos, v[pos * len(v) // 4 + 1 : (pos + 1) * len(v) // 4] as p from kept, range(4) r(pos)),
book0 as materialized (select pos, row_number() over (partition by pos order by vec_id) - 1 as e, p as c from parts where vec_id in (select vec_id from kept order by vec_id limit 256)),
""" + ",\n".join(rounds) + """,
coded as (select vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by pos) as code, cast(sum(d) as bigint) as error from near4 group by vec_id),
labelled as (select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error from coded join kept using (vec_id))
select *, (select sha256(string_agg(array_to_string(c, ','), ',' order by pos, e)) from book4) as codebooks_sha256 from labelled
"""


ORACLE_SQL = {
    "op11_vector_codes": _lloyd_sql(),
    "op13_ranked_search": r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark),
asked as (select item_id, term, count(*) as times from b group by all),
whole as (select count(*) as docs, sum(len(w)) as terms from d where len(w) > 0),
held as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from asked) group by all),
weighed as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from held, whole group by term, docs),
impacts as (select doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * cast(75 + (25 * n * docs) // terms as bigint))) as impact from held join weighed using (term), whole),
scored as (select item_id, doc_id, cast(sum(times * impact) as bigint) as score from asked join impacts using (term) group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 20
""",
    "op1_url_filters": r"""
with rules(rule_host, rule_path, says) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
fits as (select page_id, rule_host || rule_path as rule, says, row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as n
    from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select s.page_id, host, path, rule, coalesce(says, 'allow') as verdict from split s left join fits f on s.page_id = f.page_id and n = 1
""",
    "op5_html_text": r"""
with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as t from pages),
b as (select page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, url, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from b),
d as (select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from c)
select page_id, url, text, cast(length(text) as bigint) as n_chars from d
""",
    "op6_substring_dedup": r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 33)) as p from d where len(w) >= 35),
grams as (select doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) as h from starts),
again as (select h from grams group by h having count(*) > 1),
gone as (select distinct doc_id, unnest(range(p, p + 35)) as q from grams join again using (h)),
lists as (select doc_id, list(q) as qs from gone group by doc_id),
rest as (select d.doc_id, len(w) as n, coalesce(len(qs), 0) as n_removed, w, qs from d left join lists using (doc_id)),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) x
    where not exists (select 1 from gone g where g.doc_id = x.doc_id and g.q = x.i) group by doc_id)
select r.doc_id, cast(n as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from rest r left join kept using (doc_id)
""",
    "op7_decontamination": r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
starts as (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from b where len(w) > 0),
grams as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as gram from starts),
lens as (select distinct n from grams),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n),
hits as (select doc_id, p, g.n, item_id from places l join grams g on l.n = g.n and array_to_string(w[p:p + l.n - 1], ' ') = gram),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered c on d.doc_id = c.doc_id left join items i on d.doc_id = i.doc_id
""",
}

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_token_counts, op3_simhash, op4_sketches, op5_html_text, op6_substring_dedup, op7_decontamination, op8_quality, op9_mixing, op10_licenses, op11_vector_codes, op12_toxicity, op13_ranked_search)}
