"""Commits: tables that become visible together, at once, or not at all, beside concurrent writers and after crashes.

Each table of a commit is written to a folder of its own below the commit's folder.  A
small file, CURRENT, names the folders, and is put in place by one step of the file
system that either happens or does not: a link or rename that fails if the name is
taken (create), or a rename over the former file (swap).  A writer that dies before
this step leaves folders that nobody reads; sweep removes them.  The file system must
rename files in one step, as HDFS and local ones do; plain object stores do not.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.tables import exists, store_of

CURRENT = "CURRENT"


def current(spark: SparkSession, folder: str) -> dict | None:
    """What is committed at folder: the tables' folders under 'parts', and what the writer noted; None before the first commit."""
    store, place = store_of(spark, f"{folder}/{CURRENT}")
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def stage(df: DataFrame, folder: str, part: str, **options: str) -> str:
    """Write df below folder, not yet visible; gives the name of its own folder."""
    name = f"{part}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(f"{folder}/{name}")
    return name


def _pointer(spark: SparkSession, folder: str, noted: dict) -> tuple:
    store, place = store_of(spark, f"{folder}/.{CURRENT}-{uuid.uuid4().hex}")
    stream = store.create(place, False)
    try:
        stream.write(bytearray(json.dumps(noted, sort_keys=True).encode()))
    finally:
        stream.close()
    return store, place, store_of(spark, f"{folder}/{CURRENT}")[1]


def _local(spark: SparkSession, place):
    return spark.sparkContext._jvm.java.io.File(place.toUri().getPath()).toPath()


def create(spark: SparkSession, folder: str, parts: dict[str, str], **noted) -> bool:
    """Commit staged parts if nothing is committed at folder; False if another writer was first."""
    store, new, place = _pointer(spark, folder, {"parts": parts, **noted})
    try:
        if store.getScheme() != "file":
            return store.rename(new, place)  # fails where the name is taken
        if exists(spark, place.toString()):
            return False
        try:
            spark.sparkContext._jvm.java.nio.file.Files.createLink(_local(spark, place), _local(spark, new))
        except Exception:
            if exists(spark, place.toString()):
                return False
            raise
        return True
    finally:
        store.delete(new, False)


def swap(spark: SparkSession, folder: str, parts: dict[str, str], **noted) -> None:
    """Commit staged parts in the place of what is committed; readers see the former tables or the new ones."""
    jvm = spark.sparkContext._jvm
    store, new, place = _pointer(spark, folder, {"parts": parts, **noted})
    if store.getScheme() == "file":
        kind = jvm.java.nio.file.StandardCopyOption
        options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 2)
        options[0], options[1] = kind.ATOMIC_MOVE, kind.REPLACE_EXISTING
        jvm.java.nio.file.Files.move(_local(spark, new), _local(spark, place), options)
    else:
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, place, over)


def read(spark: SparkSession, folder: str, part: str) -> DataFrame | None:
    """A table of what is committed at folder; None before the first commit."""
    held = current(spark, folder)
    return None if held is None else spark.read.parquet(f"{folder}/{held['parts'][part]}")


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Remove the folders of parts that are not committed, and give their names. For times when nobody writes, or reads what was swapped."""
    held = set((current(spark, folder) or {"parts": {}})["parts"].values())
    store, place = store_of(spark, folder)
    gone = sorted(f.getPath().getName() for f in store.listStatus(place) if f.isDirectory() and f.getPath().getName() not in held)
    for name in gone:
        store.delete(store_of(spark, f"{folder}/{name}")[1], True)
    return gone
