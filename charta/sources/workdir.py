"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and Spark runs on this machine alone. No setting is changed."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{SETTING} must name a shared folder on a cluster")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/charta/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends here and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
