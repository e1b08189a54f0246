"""URL filters: host-suffix and path-prefix rules, joined on short hash prefixes.

A rule is a host, a path and an action, as in ``block example.com/de/``.  It
fits its host and every subdomain, where the url's path starts with the rule's
path; of the rules that fit, the longest string wins.

Each distinct (host, path) is expanded into its host suffixes times its path
prefixes up to each slash.  A rule is indexed under its host and the part of
its path up to the last slash, so every rule that fits a url is under one of
the url's expansions, whatever its path ends with.  The join runs on the first
hex digits of the expansion's digest; a match counts only when the full digest
of host and path, cut to the rule's length, is the rule's digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Hex digits of the digest that the join runs on.
PREFIX = 8
#: Rule tables of up to so many rows are broadcast; others are joined by a shuffle.
BROADCAST_RULES = 100_000
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def indexed(rules: DataFrame) -> DataFrame:
    """One row for each rule string; block wins where a rule is given both actions. Rules without a host or action are left out."""
    return (
        rules.select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action")
        .filter("r_host is not null and action is not null")
        .groupBy("r_host", "r_path")
        .agg(F.max("action").alias("action"))
        .withColumn("r_dir", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0))
        .select(
            F.substring(digest(F.col("r_host"), F.col("r_dir")), 1, PREFIX).alias("key"),
            digest(F.col("r_host"), F.col("r_path")).alias("full"),
            F.length("r_path").alias("r_len"),
            "r_host",
            F.concat("r_host", "r_path").alias("rule"),
            "action",
        )
    )


def expansions(pairs: DataFrame, labels: int, slashes: int) -> DataFrame:
    """(host, path, suffix, key): every host suffix of up to ``labels`` labels times every path prefix of up to ``slashes`` slashes.

    The two depths are the largest in the rules, so deeper expansions could meet no rule.
    """
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    cuts = F.split("path", "/", -1)
    depth = F.least(F.size(cuts) - 1, F.lit(slashes))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(cuts, 1, k), "/"), F.lit("/"))))
    return (
        pairs.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", "suffix", F.substring(digest(F.col("suffix"), F.col("prefix")), 1, PREFIX).alias("key"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict): one row for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, no rule and
    the default verdict.  Repeated rows are judged alike and all stay; other
    columns are not read.  Rules are distinct by host and path; equally long
    ones can both fit, then the one with the longer host wins.  An empty rule
    table gives every url the default.
    """
    found = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    table = indexed(rules)
    depth = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.size(F.split("host", r"\.", -1))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split(F.coalesce("path", F.lit("")), "/", -1)) - 1), F.lit(0)).alias("slashes"),
    ).first()
    if depth["n"] <= BROADCAST_RULES:
        table = F.broadcast(table)
    best = (
        expansions(found.select("host", "path").distinct(), max(1, depth["labels"]), depth["slashes"])
        .join(table, "key")
        .filter((F.col("suffix") == F.col("r_host")) & (digest(F.col("suffix"), F.expr("substring(path, 1, r_len)")) == F.col("full")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), "rule", "action")).alias("best"))
    )
    return found.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
