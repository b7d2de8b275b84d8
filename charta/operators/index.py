"""Canonical source index: stable ids, exact duplicates, upsert, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_id(provider: Column, external_id: Column) -> Column:
    """Stable technical id: the first 16 hex digits of SHA-256 over provider and external id."""
    return F.substring(F.sha2(F.concat_ws("|", provider, external_id), 256), 1, 16)


def described(docs: DataFrame) -> DataFrame:
    """Index rows of documents: source_id, provider, external_id, lang, sha256 of the text, its length."""
    external = F.col("doc_id").cast("string")
    return docs.select(source_id(F.col("source"), external).alias("source_id"), F.col("source").alias("provider"), external.alias("external_id"), "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(sha256, copies, keeper): texts that several documents have; the smallest doc_id is kept. Only hashes are shuffled, summed on the map side."""
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper")).filter("copies > 1")


def canonical(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical_id): each document with the smallest one of equal text."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return hashed.join(hashed.groupBy("sha256").agg(F.min("doc_id").alias("canonical_id")), "sha256").select("doc_id", "canonical_id")


def upserted(index: DataFrame, incoming: DataFrame, key: str = "source_id") -> DataFrame:
    """The index after an update: incoming rows replace rows of the same key, others stay."""
    return index.join(incoming, key, "left_anti").unionByName(incoming)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts by language and source, by language, by source and in all (grouping sets)."""
    return docs.sparkSession.sql(
        """
        SELECT lang, source, CAST(grouping_id(lang, source) AS INT) AS level, count(*) AS n_docs, sum(n_chars) AS n_chars,
               min(n_chars) AS shortest, max(n_chars) AS longest
        FROM {docs} GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""",
        docs=docs,
    )


def cube(docs: DataFrame) -> DataFrame:
    return docs.cube("lang", "source").agg(F.count("*").alias("n_docs"), F.countDistinct("n_chars").alias("n_lengths"), F.grouping_id().cast("int").alias("level"))


def language_map(docs: DataFrame) -> DataFrame:
    """(source, langs): a map from language to number of documents for each source; documents without a language are left out."""
    counts = docs.filter("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("langs"))


def approximate_statistics(docs: DataFrame) -> DataFrame:
    """By language: number of distinct texts and median length, from sketches."""
    return docs.groupBy("lang").agg(F.approx_count_distinct("text").alias("texts"), F.approx_percentile("n_chars", 0.5).alias("median_chars"))


def without_derived(tables: dict[str, DataFrame], derived: tuple[str, ...] = ("entity", "mention")) -> dict[str, DataFrame]:
    """Reset of derived tables: they keep their columns and lose their rows; sources stay."""
    return {name: df.filter(F.lit(False)) if name in derived else df for name, df in tables.items()}
