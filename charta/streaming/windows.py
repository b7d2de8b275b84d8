"""Windows over events, alike for tables and streams, and state by key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from charta.sources.tables import schema
from charta.sources.workdir import fresh_path


def stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files, with ``ts`` as a timestamp, which watermarks ask for."""
    files = spark.readStream.schema(schema("events")).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return timed(files)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(out: DataFrame) -> DataFrame:
    rest = [c for c in out.columns if c != "window"]
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *rest)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return _plain(events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _plain(events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return _plain(events.groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n")))


def late_limited(events: DataFrame, delay: str) -> DataFrame:
    """A stream whose rows count until the watermark has passed them."""
    return events.withWatermark("ts", delay)


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, remembered for as long as the watermark allows."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _totals(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for rows in batches:
        n += len(rows)
        total += float(rows["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch, from state kept by user."""
    return events.groupBy("user_id").applyInPandasWithState(_totals, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(out: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return its results, which each batch writes to the shared folder.

    append: all rows. complete: those of the last batch. update: of each of ``keys`` the rows of the
    last batch that has it. A batch that is run again replaces what it wrote. Nothing is gathered by
    the driver.
    """
    spark, path = out.sparkSession, fresh_path(out.sparkSession, "stream")

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = out.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], out.schema)
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    elif mode == "update":
        rest = [c for c in out.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return rows.select(*out.columns)
