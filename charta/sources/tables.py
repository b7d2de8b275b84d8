"""Explicit schemas of the tables and of the corpus entities; inputs are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

#: Corpus entities: what the index, the provenance operators and the accounting work on.
ENTITIES: dict[str, str] = {
    "source": "source_id string, provider string, external_id string, path string, url string, lang string, title string, sha256 string, fetched_at timestamp",
    "passage": "source_id string, line_no int, page_no int, text string",
    "reference": "source_id string, ref_no int, line_no int, target_url string, citation string",
    "claim": "conv_id bigint, turn bigint, claim_no int, source_id string, line_no int, evidence_class string",
    "mention": "source_id string, line_no int, surface string, entity_type string, lang string",
    "usage_cost": "skill string, channel string, credits decimal(10,2)",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL({**TABLES, **ENTITIES}[name])


def created(spark: SparkSession, database: str, location: str) -> list[str]:
    """The corpus entities as empty Parquet tables in a database of their own, those that are there already as they are; their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    for name, columns in ENTITIES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return [f"{database}.{name}" for name in ENTITIES]


def emptied(spark: SparkSession, database: str, names: tuple[str, ...]) -> None:
    """Derived tables lose their rows and keep their columns."""
    for name in names:
        spark.sql(f"TRUNCATE TABLE `{database}`.`{name}`")


def counted(spark: SparkSession, database: str) -> DataFrame:
    """(name, n): rows of each table of a database."""
    each = [f"SELECT '{t.name}' AS name, count(*) AS n FROM `{database}`.`{t.name}`" for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.sql(" UNION ALL ".join(sorted(each)))


#: Tables that are made from others, which a reset empties.
DERIVED = ("mention",)


def administered(spark: SparkSession, database: str, arguments: list[str], location: str = "") -> DataFrame:
    """One command of the database, as its wrapper hands it on: ``init`` (tables created; their columns), ``stats`` (rows of each table), ``reset`` (derived tables, or those named after it, emptied; rows of each)."""
    verb, names = (arguments[0], arguments[1:]) if arguments else ("", [])
    if verb == "init":
        created(spark, database, location)
        return described(spark, database)
    if verb == "reset":
        wrong = [n for n in names if n not in ENTITIES]
        if wrong:
            raise ValueError(f"no such table: {', '.join(wrong)}")
        emptied(spark, database, tuple(names) or DERIVED)
    elif verb != "stats":
        raise ValueError(f"unknown command {verb!r}; there are init, reset, stats")
    return counted(spark, database)


def described(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, position, column_name, data_type) of a database."""
    rows = [(t.name, i, c.name, c.dataType) for t in spark.catalog.listTables(database) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files under ``sf_dir``, with its declared schema."""
    return spark.read.schema(schema(name)).parquet(f"{sf_dir}/{name}.parquet")
