"""Retrieval of passages that an answer can cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charta.functions.text import lines, words


def passages(docs: DataFrame) -> DataFrame:
    """(source, doc_id, line_no from 1, text): lines that are not blank."""
    found = docs.select("source", "doc_id", F.posexplode(lines(F.col("text"))).alias("at", "text"))
    return found.filter(F.trim("text") != "").select("source", "doc_id", (F.col("at") + 1).alias("line_no"), "text")


def bm25(rows: DataFrame, terms: list[str], keys: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``keys`` and score of the rows (text) that have a term.

    A row's term counts are array expressions, so the text is read once and never shuffled; corpus
    statistics are one row, which is broadcast.
    """
    terms = list(dict.fromkeys(terms))

    def frequency(w: Column, term: str) -> Column:
        return F.size(F.filter(w, lambda x: x == term))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), *[frequency(w, t).alias(f"tf{i}") for i, t in enumerate(terms)])

    # as a generated row the counts are made once, however often they are used
    counted = rows.select(*rows.columns, F.inline(F.transform(F.array(words(F.col("text"))), counts)))
    totals = counted.agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("rows") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return scored.select(*keys, F.round(score, 6).alias("score"), "text")


def nearest(vectors: DataFrame, query: list[float], top: int = 10) -> DataFrame:
    """(vec_id, similarity, rank): the ``top`` vectors (vec_id, embedding) by cosine to one query vector, ties by vec_id.

    Products are array expressions in the scan's stage, and only each task's best rows are gathered.
    Vectors that are null, of another length, or without a length of their own are left out.
    """
    norm = sum(x * x for x in query) ** 0.5
    asked = F.array(*[F.lit(float(x)) for x in query])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    v = F.transform("embedding", lambda x: x.cast("double"))
    found = vectors.filter(F.size("embedding") == len(query)).select("vec_id", total(F.zip_with(v, asked, lambda a, b: a * b)).alias("dot"), F.sqrt(total(F.transform(v, lambda a: a * a))).alias("length"))
    best = found.filter((F.col("length") > 0) & F.lit(norm > 0)).select("vec_id", F.round(F.col("dot") / (F.col("length") * norm), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")))


def cited_top(docs: DataFrame, terms: list[str], top: int = 10) -> DataFrame:
    """The ``top`` passages for a question, with the source and line to cite."""
    scored = bm25(passages(docs), terms, ["source", "doc_id", "line_no"])
    return scored.orderBy(F.desc("score"), "doc_id", "line_no").limit(top).select("source", "doc_id", "line_no", "score", F.substring("text", 1, 120).alias("snippet"))
