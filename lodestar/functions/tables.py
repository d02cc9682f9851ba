"""Tables written to the shared folder, so that a plan that is used again is not run again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or in a temporary one where that is unset."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if top is None:
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestar-')}")
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_of(spark: SparkSession, path: str):
    """The file system of path, and path in it, as the JVM has them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = store_of(spark, path)
    return store.exists(place)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write to a new folder beside path, then put it in the place of what stands at path.

    If the write fails, what stood there is untouched.  Between two renames nothing
    stands at path; what must be there at every moment is committed (sources/commits.py).
    """
    jvm = spark.sparkContext._jvm
    mark = uuid.uuid4().hex
    place, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", f".new-{mark}", f".old-{mark}"))
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write(path.rstrip("/") + f".new-{mark}")
    if store.exists(place) and not store.rename(place, old):
        raise OSError(f"{path} can't be moved")
    if not store.rename(new, place):
        raise OSError(f"{path} can't be put in place; it is at {new}, the former at {old}")
    store.delete(old, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
