"""Folders and tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new temporary one only where that is unset."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    held = context.getCheckpointDir()
    if held is None:
        held = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        context.setCheckpointDir(held)
        held = context.getCheckpointDir()
    return held.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a later read never repeats the work, and survives
    the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bare_names(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with its columns named c0, c1 and so on, so that no name can clash with one that an operator adds, and the columns that give the names back."""
    return df.toDF(*[f"c{n}" for n in range(len(df.columns))]), [F.col(f"c{n}").alias(c) for n, c in enumerate(df.columns)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
