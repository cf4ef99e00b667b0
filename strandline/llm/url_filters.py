"""URL filters by a sort-merge range join.

A rule (host, path) is the key `reversed labels of the host, NUL, path`; the urls it fits are those with a key that
starts with it, so each rule is an interval of the sorted keys, and intervals nest or are disjoint. A url has one key
for each suffix of its host that can be a rule's host. Rules and keys are dealt into the same ranges, sorted, and swept
once with a stack of the rules that are still open. Behind its path a url's key has its whole host, so that the front pages
of a whole top-level domain aren't one key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, ascii_lower, shuffle_partitions, staged

#: (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Sampled keys for each range that the sorted keys are cut into, and the length that a cut is shortened to.
SAMPLES_PER_RANGE, CUT_CHARS = 64, 256
LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def reversed_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit("\0"), path)


def _cuts(keys: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 cuts, from a sample of bounded size that reruns draw alike."""
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLES_PER_RANGE).select(F.substring("key", 1, CUT_CHARS).alias("key"))
    found = sorted(r[0] for r in sample.collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of their keys, a rule before the urls of the same key."""
    open_rules: list[tuple[str, str, str, str]] = []
    for batch in batches:
        out = []
        for key, is_url, host, path, url_host, verdict in zip(batch["key"], batch["is_url"], batch["host"], batch["path"], batch["url_host"], batch["verdict"], strict=True):
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if not is_url:
                open_rules.append((key, host, path, verdict))
                continue
            for _, rule_host, rule_path, says in reversed(open_rules):
                if rule_host == host and path.startswith(rule_path):  # a label may hold a comma
                    out.append((url_host, path, rule_host, rule_path, says))
                    break
        yield pd.DataFrame(out, columns=["host", "path", "rule_host", "rule_path", "says"])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    rules: host, path, verdict. A rule fits its host and all its subdomains where the path starts with the rule's;
    the longest (host and path together) wins, at equal length the one of the longer host, and of two verdicts for
    one rule `block`. Null and malformed urls have an empty host and path; no rule: a null rule and the default. Rules
    without a host or a verdict are left out. Repeated urls are judged once; repeated rows stay. Urls are used whole,
    however long. Other columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    added = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c not in added]
    pages = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias("")).alias("row"), host.alias("host"), path.alias("path"))
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    urls = staged(pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    probes = urls.select(F.col("host").alias("url_host"), "path", F.explode(suffixes).alias("host"))
    probes = probes.withColumn("key", F.concat(reversed_key(F.col("host"), F.col("path")), F.lit("\0"), "url_host"))

    ranges = shuffle_partitions(spark)
    cuts = _cuts(probes.select("key"), ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(cuts, k)).astype("int32")

    key = reversed_key(F.col("host"), F.col("path"))
    opened = rules.withColumn("key", key).withColumns({"first": range_of("key"), "last": range_of(F.concat("key", F.lit(LAST)))})
    opened = opened.select("key", F.lit(False).alias("is_url"), "host", "path", F.lit("").alias("url_host"), "verdict", F.explode(F.sequence("first", "last")).alias("range"))
    probes = probes.select("key", F.lit(True).alias("is_url"), "host", "path", "url_host", F.lit("").alias("verdict"), range_of("key").alias("range"))
    swept = (
        opened.unionByName(probes)
        .repartitionById(ranges, "range")
        .sortWithinPartitions("key", "is_url")
        .drop("range")
        .mapInPandas(_sweep, "host string, path string, rule_host string, rule_path string, says string")
    )
    best = swept.groupBy("host", "path").agg(
        F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), "says")).alias("best")
    )
    best = urls.join(best, ["host", "path"]).select(F.struct("host", "path").alias("at"), "n", F.col("best.rule").alias("rule"), F.col("best.says").alias("says"))
    best = staged(best, "judged-urls")
    total = urls.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(best.where(F.col("n") * HOT > total))  # fewer than HOT urls, whose rows stay where they are
    pages = pages.withColumn("at", F.struct("host", "path"))
    judged = pages.join(hot.select("at", F.col("rule").alias("r"), F.col("says").alias("s")), "at", "left")
    # rows without a host, or judged by now, meet nobody: their key is a number of their own
    cold = best.where(F.col("n") * HOT <= total).select(F.struct("at", F.lit(0).cast("long").alias("i")).alias("met"), "rule", "says")
    done = F.col("r").isNotNull() | (F.col("host") == "")
    judged = judged.withColumn("met", F.struct("at", F.when(done, F.xxhash64("row")).otherwise(F.lit(0).cast("long")).alias("i"))).join(cold, "met", "left")
    out = judged.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "host", "path", F.coalesce("r", "rule").alias("rule"), F.coalesce("s", "says", F.lit(default)).alias("verdict"))
    return out
