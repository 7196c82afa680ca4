"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

A rule is a host and a path.  It fits its host and all subdomains if the url's path starts with the
rule's path; of all rules that fit, the one with the longest host + path wins (then the longer host).
A url expands into host suffixes x path prefixes (of the lengths that rules have); each expression's
4-byte hash prefix is looked up first, and a hit counts only if the full SHA-256 digest agrees.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; urls
that no rule fits get ``default`` as their verdict; repeated rules count once, and block wins where
the same host and path is both blocked and allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 2_000_000) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row; ``rules`` has ``host, path, verdict``.

    Rules are broadcast up to ``broadcast_rules`` of them (about 100 bytes each); beyond that both
    sides are shuffled, after the urls' expressions were reduced to distinct ones, so that no host is hot.
    """
    rule = F.concat("host", "path")
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    listed = listed.select(
        rule.alias("rule"), "verdict", F.length("path").alias("path_len"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"), F.length("host").alias("host_len")
    ).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set("path_len").alias("lens")).first()
    lens = F.array(*[F.lit(x) for x in sorted(facts["lens"])]) if facts["lens"] else F.array().cast("array<int>")
    pages = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lens, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    small = facts["n"] <= broadcast_rules
    sites = pages.where("host <> ''").select("host", "path").distinct()
    asked = sites.select("host", "path", F.explode(F.array_distinct(asked)).alias("expression")).withColumn("digest", F.sha2("expression", 256))
    asked = asked.withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    order = F.struct(F.length("rule"), "host_len", "rule", "verdict")
    if small:
        hits = asked.join(F.broadcast(listed), "short").where(asked["digest"] == listed["digest"])
    else:
        distinct = asked.select("short", "digest").distinct()
        known = distinct.join(listed, "short").where(distinct["digest"] == listed["digest"]).select(distinct["digest"], "rule", "verdict", "host_len")
        hits = asked.join(known, "digest")
    best = hits.groupBy(asked["host"], asked["path"]).agg(F.max(order).alias("won"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(key, "host", "path", F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"))
