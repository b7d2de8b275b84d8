"""Named entities by rule: capitalised names, gazetteer, record lookup, fuzzy match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charta.functions.text import folded, lines

NAME = r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, line_no, surface): runs of two or more capitalised words."""
    found = docs.select("doc_id", "lang", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    return found.select("doc_id", "lang", (F.col("at") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(NAME), F.lit(1))).alias("surface"))


def top_by_language(found: DataFrame, top: int = 5) -> DataFrame:
    """Each language's most frequent names, ties by name."""
    counts = found.groupBy("lang", "surface").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "surface"))).filter(F.col("rank") <= top)


def typed(found: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Mentions with the entity type that a gazetteer (surface, entity_type) gives them, compared without accents and case."""
    keyed = gazetteer.select(folded(F.col("surface")).alias("key"), "entity_type").distinct()
    return found.withColumn("key", folded(F.col("surface"))).join(keyed, "key", "left").drop("key")


def normalised_name(name: Column) -> Column:
    """Folded, white space single, and words in order, so that word order does not matter."""
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(folded(name), r"[\s,]+", " ")), " ")), " ")


def looked_up(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (name) with the records (record_id, full_name) of the same normalised name."""
    keyed = records.select("record_id", "full_name", normalised_name(F.col("full_name")).alias("key"))
    return requests.withColumn("key", normalised_name(F.col("name"))).join(keyed, "key", "left").drop("key")


def fuzzy(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance): strings within ``most`` edits of each other.

    Blocking loses nothing: a string cut into most + 1 pieces has at least one piece unchanged in any
    string that near, moved by ``most`` places at the utmost. Pieces join by equality of content, of
    the other's length and of place.
    """
    k = most + 1

    def cuts(length: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("i"), F.floor(i * length / k).cast("int").alias("a"), F.floor((i + 1) * length / k).cast("int").alias("z")))

    pieces = left.select(F.col("s").alias("a"), F.length("s").alias("la"), F.explode(cuts(F.length("s"))).alias("c")).select("a", "la", F.col("c.i").alias("i"), F.expr("substring(a, c.a + 1, c.z - c.a)").alias("piece"))
    lengths = F.explode(F.sequence(F.greatest(F.lit(0), F.length("s") - most), F.length("s") + most)).alias("la")
    probes = right.select(F.col("s").alias("b"), lengths).withColumn("c", F.explode(cuts(F.col("la")))).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c.a") - most), F.col("c.a") + most)))
    probes = probes.select("b", "la", F.col("c.i").alias("i"), F.expr("substring(b, at + 1, c.z - c.a)").alias("piece"))
    met = pieces.join(probes, ["la", "i", "piece"]).select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)
