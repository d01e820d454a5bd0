"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every distinct (host, path) is expanded into the host suffixes and path prefixes a rule could
have, each expression is hashed, and an equi-join on the first hex digits of the digest finds
candidates; the full digest confirms them and the longest rule wins.  DataFrame functions only.

Scale: pages are reduced to distinct (host, path) pairs before anything is expanded, and only
the verdicts travel back.  Expansions are bounded by the rules (labels and slashes of the longest
rule, lengths of rules that end inside a path segment), so no rule can be missed.  A prefix shared
by very many sites is a hot key of the first join; its other side has one row per rule, so AQE
splits it without repeating rules' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most_labels: int) -> Column:
    """Suffixes at label borders, as long as a rule's host can be."""
    parts = F.split(host, "\\.", -1)
    first = F.greatest(F.lit(1), F.size(parts) - F.lit(most_labels - 1))
    return F.transform(F.sequence(first, F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def path_prefixes(path: Column, most_slashes: int, lengths: list[int]) -> Column:
    """Prefixes that end in a slash, and those of the given lengths."""
    slashes = F.least(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), F.lit(most_slashes))
    dirs = F.when(slashes > 0, F.transform(
        F.sequence(F.lit(1), slashes),
        lambda i: F.concat(F.array_join(F.slice(F.split(path, "/", -1), F.lit(1), i), "/"), F.lit("/"))))
    empty = F.array().cast("array<string>")
    cut = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_distinct(F.concat(F.coalesce(dirs, empty), F.array_compact(F.array(*cut)) if cut else empty))


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_digest", F.sha2("_expression", 256)).withColumn(
        "_prefix", F.substring("_digest", 1, PREFIX_DIGITS))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """page id, host, path, rule (host + path of the rule that wins, else null) and verdict.

    ``rules`` has host (lower case), path and verdict.  A rule fits its host and all subdomains
    of it, if the path starts with the rule's; the longest (host and path together, then the
    longer host) wins; of two equal rules ``block`` wins.  A URL that is null or has no ``://``
    has an empty host and path.  Repeated pages are judged row by row; other columns of either
    input are not read; empty inputs give an empty result or the default verdict.
    """
    rules = rules.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(
        F.max("verdict").alias("_verdict"))
    # a few numbers about the rules, bounded by the longest rule
    slash_end = F.col("_path").endswith("/")
    facts = rules.agg(
        F.max(F.size(F.split("_host", "\\.", -1))).alias("labels"),
        F.max(F.when(slash_end, F.size(F.split("_path", "/", -1)) - 1)).alias("slashes"),
        F.collect_set(F.when(~slash_end, F.length("_path"))).alias("lengths")).first()
    rules = hashed(rules.withColumn("_expression", F.concat("_host", "_path"))).select(
        "_prefix", F.col("_digest").alias("_rule_digest"), F.col("_expression").alias("rule"),
        F.length("_host").alias("_host_length"), F.col("_verdict").alias("verdict"))

    seen = pages.select(F.col(page_id).alias(page_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = host_suffixes(F.col("host"), facts["labels"] or 1)
    prefixes = path_prefixes(F.col("path"), facts["slashes"] or 0, sorted(facts["lengths"]))
    sites = seen.select("host", "path").distinct()
    asked = (sites.withColumn("_suffix", F.explode(hosts)).withColumn("_start", F.explode(prefixes))
             .select("host", "path", F.concat("_suffix", "_start").alias("_expression")))
    best = (hashed(asked).drop("_expression").join(rules, "_prefix")
            .filter(F.col("_digest") == F.col("_rule_digest"))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule"), "_host_length", "rule", "verdict")).alias("_best"))
            .select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict")))
    return seen.join(best, ["host", "path"], "left").select(
        page_id, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
