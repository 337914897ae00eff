"""URL rules by host and path: hash-prefix look-up, full digests, precedence.  DataFrame functions only.

A URL's host is expanded into its suffixes, which meet the rules' hosts in an equi-join on short prefixes of their digests;
under each host that is met, the path is expanded into prefixes of the lengths that its rules have, and these expressions
meet the rules in a second such join.  Equal full digests confirm a hit, and the longest rule decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_light, join_small, stored

#: Hexadecimal digits of the digest that the join compares.
SHORT = 8


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://, or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://, or for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages (of which columns of these names are replaced); rules: host, path, verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's path; the longest rule (host and path
    together, then host) wins, and of equal ones `block`; without one, rule is null and the verdict is `default`.  Null
    URLs and those without :// have an empty host and fit no rule.  Rules with an empty or null host or verdict fit
    nothing; a null path is empty.  Repeated pages are judged each; without rules all get the default.
    """
    rules = rules.where("host <> '' and verdict is not null").select(
        F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).distinct()
    rules = stored(_keyed(rules.withColumn("r_text", F.concat("r_host", "r_path")), "r_text"), "rules")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = lambda host: F.size(F.split(host, r"\."))
    most = rules.agg(F.max(labels("r_host"))).first()[0]
    if most is None:
        discard(rules)
        return pages.select(
            *kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        )
    asked = pages.where("host <> ''").select(F.col("host").alias("q_host"), F.col("path").alias("q_path")).distinct()
    # hosts: their suffixes of at most as many labels as any rule's, and the lengths of the paths under the rules' hosts
    hosts = _keyed(rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")), "r_host")
    parts = asked.select("q_host").distinct().withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.least(labels("q_host"), F.lit(most)))),
    )
    parts = _keyed(
        parts.withColumn("suffix", F.expr("substring_index(q_host, '.', -n)")), "suffix",
    ).select("q_host", "short", F.col("digest").alias("q_digest"))
    under = join_small(parts, hosts, ["short"], "inner").where("q_digest = digest")
    under = stored(under.groupBy("q_host").agg(F.collect_list(F.struct("r_host", "lengths")).alias("under")), "hosts")
    # paths: prefixes of those lengths
    asked = join_light(asked, under, ["q_host"], "inner").select("q_host", "q_path", F.explode("under").alias("u"))
    asked = asked.select(
        "q_host", "q_path", "u.r_host",
        F.explode(F.filter("u.lengths", lambda n: n <= F.length("q_path"))).alias("chars"),
    )
    asked = _keyed(
        asked.withColumn("q_text", F.concat("r_host", F.expr("substring(q_path, 1, chars)"))), "q_text",
    ).select("q_host", "q_path", "short", F.col("digest").alias("q_digest"))
    hits = join_light(asked, rules, ["short"], "inner").where("q_digest = digest")
    rank = F.struct(F.length("r_text"), F.length("r_host"), F.col("r_verdict") == "block", "r_verdict")
    best = hits.groupBy("q_host", "q_path").agg(F.max(F.struct(rank.alias("rank"), "r_text")).alias("best"))
    # a table of its own, so that the join can split a host and path that many pages have
    best = stored(
        best.select(
            F.col("q_host").alias("host"), F.col("q_path").alias("path"), F.col("best.r_text").alias("rule"),
            F.col("best.rank.r_verdict").alias("verdict"),
        ),
        "best",
    )
    discard(under, rules)
    out = join_light(pages, best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _keyed(rows: DataFrame, column: str) -> DataFrame:
    """Adds the digest of a column, and the short prefix of it that joins compare."""
    return rows.withColumn("digest", F.sha2(column, 256)).withColumn("short", F.substring("digest", 1, SHORT))
