"""URL filters: host suffixes and path prefixes against a rule list, by hash prefixes.

Each URL expands into expressions, one for each of its host's suffixes of as many labels as some
rule's host may have, and each of its path's prefixes that has the length of some rule's path. Expressions meet rules by an equi-join on
four bytes of their SHA-256; the full digests are then compared, and of the rules that fit the most
specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast; longer lists are joined by shuffle.
BROADCAST_RULES = 200_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a DataFrame."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def label_count(host_: Column) -> Column:
    return F.length(host_) - F.length(F.replace(host_, F.lit("."), F.lit(""))) + 1


def expressions(host_: Column, path_: Column, depths: list[int], lengths: list[int]) -> Column:
    """Structs (host, path, text) of the host suffixes of the given numbers of labels with the path prefixes of the given lengths."""
    suffixes = F.array_compact(F.array(*[F.when(label_count(host_) >= n, F.substring_index(host_, ".", -n)) for n in depths]))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path_)), lambda n: F.substr(path_, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    rules: verdict, rule_host, rule_path. A rule fits its host and all subdomains when the URL's path
    begins with its path. The rule with the longest host and path together wins, then the longer host,
    then block before allow. No rule: null, and ``otherwise``. Rules with nulls are left out; a rule
    that is listed twice counts once. Null URLs, or those without ``://``, have an empty host and path;
    only a rule of an empty host fits them. Every row of ``pages`` is judged, repeated ones too; very
    long URLs as all others. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    spark = pages.sparkSession
    rules = rules.filter("rule_host is not null and rule_path is not null and verdict is not null").select("verdict", "rule_host", "rule_path").distinct()
    number, lengths, depths = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("rule_path"))), F.sort_array(F.collect_set(label_count(F.col("rule_host"))))).first()
    text = F.concat("rule_host", F.lit("\n"), "rule_path")
    table = rules.select("verdict", "rule_host", "rule_path", F.sha2(text, 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, 8))
    if number <= BROADCAST_RULES:
        table = F.broadcast(table)
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("page")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), whole, F.col("`url`").cast("string").alias("url"))
    rows = rows.select("row", "page", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # a row without expressions stays, and what a row expands to meets again under its number
    tried = rows.withColumn("text", F.explode_outer(expressions(F.col("host"), F.col("path"), depths or [1], lengths or [0])))
    tried = tried.withColumn("sha", F.sha2("text", 256)).withColumn("prefix", F.substring("sha", 1, 8))
    fits = tried.join(table, "prefix", "left")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("verdict") == "block"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))
    best = fits.groupBy("row").agg(F.max(F.when(F.col("sha") == F.col("digest"), order)).alias("best"), *[F.first(c).alias(c) for c in ("page", "host", "path")])
    pages_ = [F.col(f"page.c{i}").alias(c) for i, c in enumerate(kept)]
    return best.select(*pages_, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
