"""A pipeline over ``documents``: quality classifier, line dedup, near duplicates, source mixing, tokens.

Every stage takes what the stage before kept, written as Parquet and read again; all but the last
return the columns of ``documents``, whatever their number and names, as long as doc_id, text and
source are there. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charta.llm import bpe, classifier, jaccard_join, line_dedup, mixing
from charta.llm.queries import pattern, vocabulary
from charta.llm.workdir import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good.

    Null and empty texts get the sample's share of good ones as score, so they stay where that is the
    threshold or more. Equal texts, and repeated rows, are judged alike; a null doc_id is no label's.
    """
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share.

    Null texts stay null, empty ones empty; a text whose every line goes is empty. Each row counts as a
    document, repeated ones too.
    """
    return line_dedup.cleaned(docs, min_docs=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id of a group stays. Null, empty and wordless texts are near nothing and stay, and
    so do rows without a doc_id; rows of one doc_id stay or go together.
    """
    return jaccard_join.deduplicated(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at flattened weights: the largest is seen once, none more than twice.

    A null source is a source. Null, empty and wordless texts cost nothing and come once. Which of
    several equal rows comes once more is left to chance, how many of them is not.
    """
    return mixing.realised(docs, max_repeat=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) with their number, and the SHA-256 of the bytes that they decode to.

    Null and empty texts have no ids. Repeated rows are encoded alike.
    """
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(), decoded=True, without_text=True, pattern=pattern())
    return out.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("source mixing", mix), ("byte-level BPE", tokens)]

#: SQL has no model fit and no BPE; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
