"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir (below the warehouse where that is unset)."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")
    return f"{base}/{name}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch folder and read back: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(table: DataFrame) -> int:
    """The size of a table that was read from files, as the planner knows it; nothing is run."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its files are too few for that: one shuffle of at most
    `spark.sql.files.maxPartitionBytes` a core. Larger tables are read by enough tasks as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if stored_bytes(df) < cores * most else df
