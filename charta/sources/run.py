"""Dispatched requests run against local tables that stand for the remote sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charta.functions.text import folded, slug, words
from charta.operators.entities import looked_up
from charta.sources.connectors import read_texts
from charta.sources.fetch import first_line

#: Requests of a run up to this number are broadcast to the tables; a run with more is an error, not a larger broadcast.
REQUESTS = 10_000
#: The index of persons that each person connector asks.
PERSON_INDEXES = {"dodis-person": "dodis", "elitesuisse": "elitesuisse"}


def option(extra: Column, name: str) -> Column:
    """The value after a flag in the tokens passed through; null without the flag, or when a flag or nothing follows it."""
    after = F.transform(F.filter(F.sequence(F.lit(0), F.size(extra)), lambda i: F.get(extra, i) == name), lambda i: F.get(extra, i + 1))
    value = F.get(after, F.lit(0))
    return F.when(~F.startswith(value, F.lit("-")), value)


def executed(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(case_id, name, ref, title): what every request of ``requests`` (see ``registry.dispatched``) finds.

    tables, as far as there are any: documents (doc_id, text, lang, source), pages (page_id, url,
    title), persons (index, record_id, full_name), articles (doc_id, text, year). Encyclopedia, page,
    person and vote requests are equi-joins; dictionary terms and newspaper words are looked for in
    every heading or article, with the requests broadcast. Requests that did not run, have no main
    value or ask for ``--dry-run`` find nothing.
    """
    runs = requests.filter((F.col("outcome") == "run") & (F.col("main") != "") & ~F.array_contains("extra", "--dry-run"))
    if runs.limit(REQUESTS + 1).count() > REQUESTS:
        raise ValueError(f"more than {REQUESTS} requests in one run")
    asked = F.broadcast(runs.select("case_id", "name", "main", "extra"))
    of = lambda *names: asked.filter(F.col("name").isin(*names))
    found: list[DataFrame] = []

    def add(rows: DataFrame, ref: str, title: Column) -> None:
        found.append(rows.select("case_id", "name", F.col(ref).cast("string").alias("ref"), title.alias("title")))

    if "documents" in tables:
        docs = tables["documents"].select("doc_id", "lang", "source", first_line(F.col("text")).alias("heading"))
        add(docs.join(of("dhs"), F.contains(folded(F.col("heading")), folded(F.col("main")))), "doc_id", F.col("heading"))
        lang = option(F.col("extra"), "--lang")
        titled = docs.withColumn("slug", slug(F.col("heading"))).join(of("wikipedia").withColumn("slug", slug(F.col("main"))), "slug")
        add(titled.filter(lang.isNull() | (F.col("lang") == lang)), "doc_id", F.col("heading"))
        add(docs.join(of("dodis-document").withColumn("doc_id", F.expr("try_cast(main AS BIGINT)")), "doc_id"), "doc_id", F.col("heading"))
        add(docs.join(of("swissvote").withColumn("source", F.concat(F.lit("src"), "main")), "source"), "doc_id", F.col("heading"))
    if "pages" in tables:
        pages = tables["pages"].select("page_id", "url", "title")
        add(pages.join(of("url", "enewspaper-content").withColumn("url", F.col("main")), "url"), "page_id", F.col("title"))
        part = lambda c, name: F.expr(f"try_parse_url({c}, '{name}')")
        results = pages.withColumns({"host": part("url", "HOST"), "query": part("url", "QUERY")})
        add(results.join(of("dodis").withColumns({"host": part("main", "HOST"), "query": part("main", "QUERY")}), ["host", "query"]), "page_id", F.col("title"))
    if "persons" in tables:
        for name, index in PERSON_INDEXES.items():
            people = looked_up(of(name).withColumnRenamed("name", "connector").withColumnRenamed("main", "name"), tables["persons"].filter(F.col("index") == index))
            add(people.filter("record_id is not null").withColumn("name", F.col("connector")), "record_id", F.col("full_name"))
    if "articles" in tables:
        start, end = (F.expr(f"try_cast(v{i} AS INT)") for i in range(2))
        papers = of("enewspaper").withColumns({"asked": F.array_distinct(words(F.col("main"))), "v0": option(F.col("extra"), "--start-year"), "v1": option(F.col("extra"), "--end-year")})
        papers = papers.filter(F.size("asked") > 0)
        hits = tables["articles"].withColumn("w", F.array_distinct(words(F.col("text")))).join(papers, F.size(F.array_except("asked", "w")) == 0)
        add(hits.filter((start.isNull() | (F.col("year") >= start)) & (end.isNull() | (F.col("year") <= end))), "doc_id", first_line(F.col("text")))
    return reduce(DataFrame.unionByName, found)


def article_list(articles: DataFrame, query: str, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Articles (doc_id, year, text) that have all words of a query, between two years (both included), as a list sorted by year and doc_id with place."""
    wanted = F.array_distinct(words(F.lit(query)))
    found = articles.filter((F.size(wanted) > 0) & (F.size(F.array_except(wanted, words(F.col("text")))) == 0))
    if start_year is not None:
        found = found.filter(F.col("year") >= start_year)
    if end_year is not None:
        found = found.filter(F.col("year") <= end_year)
    return found.select("year", "doc_id", first_line(F.col("text")).alias("title")).orderBy("year", "doc_id")


def listed_contents(spark: SparkSession, path: str, pages: DataFrame, array: bool = False) -> DataFrame:
    """(url, page_id, html): the contents of the addresses in a JSON list of articles (objects with ``url``, one a line, or an array of them a file), null where there is none."""
    wanted = spark.read.schema("url string").option("multiLine", str(array).lower()).json(path).filter("url is not null").distinct()
    return wanted.join(pages, "url", "left").select("url", "page_id", "html")


def folder_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """The text files of a source folder as documents (doc_id: hash of the path, text, lang, source); lang is the last part of the file's name, if it has two letters."""
    files = read_texts(spark, path, glob)
    name = F.regexp_extract("path", r"_([a-z]{2})\.[^./]*$", 1)
    return files.select(F.xxhash64("path").alias("doc_id"), "text", F.nullif(name, F.lit("")).alias("lang"), F.col("provider").alias("source"))
