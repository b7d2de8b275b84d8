"""What each connector selects, over local tables that stand for the remote ones.

Every function is a filter or an equi-join, so predicates reach the scan; nothing is downloaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charta.functions.text import folded, lines, slug


def first_line(text: Column) -> Column:
    return F.get(lines(text), F.lit(0))


def by_term(articles: DataFrame, term: str) -> DataFrame:
    """Dictionary articles whose heading, the first line, has the term; accents and case don't matter."""
    return articles.filter(F.contains(folded(first_line(F.col("text"))), F.lit(term.lower())))


def by_title(articles: DataFrame, title: str, lang: str | None = None) -> DataFrame:
    """Encyclopedia articles of a title, compared as slugs, in a language if one is named."""
    found = articles.filter(slug(first_line(F.col("text"))) == slug(F.lit(title)))
    return found if lang is None else found.filter(F.col("lang") == lang)


def by_id(documents: DataFrame, key: str, value) -> DataFrame:  # noqa: ANN001
    """A document by its identifier; the filter is pushed to the scan."""
    return documents.filter(F.col(key) == value)


def search(pages: DataFrame, host: str, **query: str) -> DataFrame:
    """Results of a search: pages of a host whose address has the query's values."""
    found = pages.filter(F.expr("try_parse_url(url, 'HOST')") == host)
    for name, value in query.items():
        found = found.filter(F.expr(f"try_parse_url(url, 'QUERY', '{name}')") == value)
    return found


def contents(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content of the addresses in ``wanted`` (url), with null where there is none."""
    return wanted.select("url").distinct().join(pages, "url", "left")


def sources_of(votes: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Every document of each vote: one to many by the vote's identifier."""
    return votes.join(documents, key).withColumn("ordinal", F.row_number().over(_by(key)))


def _by(key: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("doc_id")
