"""Lexical fields: term and document frequency, TF-IDF, co-occurrence, key word in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charta.functions.text import word_counts, words
from charta.operators.entities import fuzzy


def term_frequency(docs: DataFrame) -> DataFrame:
    """(term, tf, df) over all documents, each row one: counted within the row, then one shuffle of terms that each task has summed."""
    return docs.select(F.inline(word_counts(F.col("text")))).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def tfidf(docs: DataFrame, top: int = 3) -> DataFrame:
    """Each document's ``top`` terms by tf * ln(N / df), ties by term."""
    counts = docs.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    scored = counts.join(df, "term").join(F.broadcast(total)).withColumn("score", F.round(F.col("tf") * F.log(F.col("n_docs") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("doc_id", "term", "tf", "df", "score", "rank")


def bigrams(docs: DataFrame, least: int = 2) -> DataFrame:
    """(first, second, n) of neighbouring words that occur ``least`` times or more."""
    w = words(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("first"), F.get("w", i + 1).alias("second")))
    found = docs.select(w.alias("w")).filter(F.size("w") > 1).select(F.explode(pairs).alias("p"))
    return found.groupBy("p.first", "p.second").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def in_context(docs: DataFrame, term: str, width: int = 3) -> DataFrame:
    """Every occurrence of a term with ``width`` words on both sides."""
    found = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode("w").alias("at", "word")).filter(F.col("word") == term)
    left = F.slice("w", F.greatest(F.col("at") - width + 1, F.lit(1)), F.least(F.col("at"), F.lit(width)))
    return found.select("doc_id", (F.col("at") + 1).alias("word_no"), F.array_join(left, " ").alias("before"), F.array_join(F.slice("w", F.col("at") + 2, F.lit(width)), " ").alias("after"))


def unknown_rate(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, n_words, n_unknown, rate): words that a lexicon (term) lacks, counted by distinct term first."""
    terms = docs.select("lang", F.explode(words(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    known = lexicon.select("term").distinct().withColumn("known", F.lit(1))
    counted = terms.join(known, "term", "left").groupBy("lang").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"))
    return counted.withColumn("rate", F.round(F.col("n_unknown") / F.col("n_words"), 9))


def corrections(unknown: DataFrame, lexicon: DataFrame, most: int = 1) -> DataFrame:
    """(term, suggestion, distance): for unknown terms the nearest lexicon entry within ``most`` edits, ties by entry; blocking (see ``entities.fuzzy``) loses nothing."""
    near = fuzzy(unknown.select(F.col("term").alias("s")), lexicon.select(F.col("term").alias("s")), most)
    return near.groupBy(F.col("a").alias("term")).agg(F.min(F.struct("distance", F.col("b").alias("suggestion"))).alias("n")).select("term", "n.suggestion", "n.distance")


def overlap(a: Column, b: Column) -> Column:
    """Share of common words of two texts (Jaccard of word sets)."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), F.lit(0.0))
