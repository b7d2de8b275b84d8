"""Readers and sinks: Markdown, text, JSON, HTML and any bytes; a registered offline source for connectors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from charta.functions.text import html_links, html_text, html_title, markdown
from charta.sources.registry import registry_rows


class _RegistryReader(DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from registry_rows()


class ConnectorSource(DataSource):
    """``spark.read.format("connectors")``: the registry as a table."""

    @classmethod
    def name(cls) -> str:
        return "connectors"

    def schema(self) -> str:
        from charta.sources.registry import REGISTRY_SCHEMA

        return REGISTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _RegistryReader()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConnectorSource)


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, provider, text) of text files under a folder with one folder for each provider, named by it alone or as a partition."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.withColumn("provider", F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^provider=", ""))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, text): files of any kind; text for those whose name says so, PDF and others without."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(kind.isin("md", "txt", "html", "htm", "json", "csv"), F.decode("content", "UTF-8"))
    return files.select("path", kind.alias("kind"), "length", text.alias("text"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Source descriptions in JSON, one object a line, with the index's columns."""
    return spark.read.schema("provider string, external_id string, url string, lang string, title string").json(path)


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """Delimited text with a header; quoted values may hold separators and line breaks."""
    return spark.read.schema(schema).option("header", "true").option("sep", separator).option("multiLine", "true").option("escape", '"').csv(path)


def table_lines(rows: DataFrame, key: str) -> DataFrame:
    """(line_no, line): a table as Markdown text, rows in the order of ``key``; for tables that a person reads."""
    cell = lambda c: F.concat(F.lit(" "), F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(" |"))
    body = rows.select(F.row_number().over(Window.orderBy(F.col(f"`{key}`"))).alias("at"), F.concat(F.lit("|"), *[cell(c) for c in rows.columns]).alias("line"))
    head = [(1, "| " + " | ".join(rows.columns) + " |"), (2, "|" + " --- |" * len(rows.columns))]
    return rows.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body.select((F.col("at") + 2).alias("line_no"), "line"))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages with title, text, Markdown and links."""
    return pages.select("page_id", "url", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"), markdown(F.col("html")).alias("markdown"), html_links(F.col("html")).alias("links"))


def url_parts(pages: DataFrame) -> DataFrame:
    """(page_id, scheme, host, path, query)."""
    part = lambda name: F.expr(f"try_parse_url(url, '{name}')")
    return pages.select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"))


def write_markdown(sources: DataFrame, path: str) -> None:
    """Sources (provider, text) as text files, a folder for each provider."""
    sources.select("provider", "text").write.mode("overwrite").partitionBy("provider").text(path, lineSep="\n")


def write_documents(sources: DataFrame, path: str) -> None:
    """Sources (provider, text) as JSON lines, a folder for each provider; line breaks in a text stay in it. Sources without a provider stay out."""
    sources.select("provider", "text").filter("provider is not null").write.partitionBy("provider").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(provider, text) of a folder that ``write_documents`` wrote; only the folders of providers that are asked for are read."""
    return spark.read.schema("text string, provider string").json(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("provider").parquet(path)
