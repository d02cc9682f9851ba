"""Files: typed sinks, deterministic exports, inventories, strict loads, nested documents, snapshots."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lodestar.functions.columns import fail_if_any
from lodestar.functions.tables import exists, replace
from lodestar.functions.workers import send_package
from lodestar.sources import commits


def write_typed(df: DataFrame, path: str, schema: str, compression: str = "zstd") -> None:
    """df cast to schema, as Parquet under path; what was there is replaced when all of it is written. A cell that can't be cast raises."""
    kind: StructType = _parse_datatype_string(schema)
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields])
    replace(df.sparkSession, path, lambda new: typed.write.option("compression", compression).parquet(new))


def write_gated(df: DataFrame, folder: str, schema: str, findings: DataFrame, compression: str = "zstd", **noted) -> None:
    """df cast to schema, and the findings of its gate, committed at folder together: readers see both or neither, and the former two until then. noted is kept beside them."""
    kind: StructType = _parse_datatype_string(schema)
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields])
    parts = {name: commits.stage(rows, folder, name, compression=compression) for name, rows in (("rows", typed), ("findings", findings))}
    commits.swap(df.sparkSession, folder, parts, **noted)


def read_snapshot(spark: SparkSession, folder: str, kind: str, as_of: str, schema: str) -> DataFrame:
    """The snapshot of kind and as_of; one that is not there is empty."""
    path = f"{folder}/kind={kind}/as_of={as_of}"
    held = commits.current(spark, path)
    return spark.createDataFrame([], schema) if held is None else spark.read.schema(schema).parquet(f"{path}/{held['parts']['data']}")


def write_lines(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines in order of keys over all files; the same rows give the same lines."""
    ordered = df.select(*sorted(df.columns)).orderBy(*keys)
    replace(df.sparkSession, path, lambda new: ordered.write.option("ignoreNullFields", "false").json(new))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """entity, group of a CSV; no rows, empty cells and entities that stand twice raise."""
    df = spark.read.schema("entity string, `group` string").option("header", True).csv(path)
    fail_if_any(df.agg(F.count("*").alias("n")).where("n = 0"), "an empty mapping")
    fail_if_any(df.where("coalesce(trim(entity), '') = '' or coalesce(trim(`group`), '') = ''"), "empty cells")
    fail_if_any(df.groupBy("entity").count().where("count > 1"), "entities that stand twice")
    return df


def write_mapping(mapping: DataFrame, path: str) -> None:
    """entity, group as CSV in order of both, as read_mapping reads it; what was there is replaced when all of it is written."""
    ordered = mapping.select("entity", "group").orderBy("entity", "group")
    replace(mapping.sparkSession, path, lambda new: ordered.write.option("header", True).csv(new))


#: Bytes of a file that a task takes at once; larger files are read in blocks.
WHOLE, BLOCK = 256 << 20, 8 << 20

_INSPECTED = "path string, bytes long, modified timestamp, sha256 string, kind string, state string, rows long, columns array<string>, declared_as_of string"


def _inspect(kind: str, data: bytes, envelope: str) -> tuple:
    """state, rows, columns, declared day of a file's content."""
    if kind == "parquet":
        import pyarrow.parquet as pq

        told = pq.ParquetFile(io.BytesIO(data))
        return "ok" if told.metadata.num_rows else "empty", told.metadata.num_rows, told.schema_arrow.names, None
    text = data.decode("utf-8-sig")
    if kind == "csv":
        lines = csv.reader(io.StringIO(text, newline=""), strict=True)
        columns = next(lines, None)
        if columns is None:
            return "empty", 0, [], None
        rows = 0
        for line in lines:
            if line and len(line) != len(columns):
                raise ValueError("a row of another width")
            rows += bool(line)
        return "ok" if rows else "empty", rows, columns, None
    told = json.loads(text)
    records = told.get(envelope) if isinstance(told, dict) else told
    if not isinstance(records, list):
        return "other_shape", None, sorted(told) if isinstance(told, dict) else None, None
    names = sorted({k for r in records if isinstance(r, dict) for k in r})
    return "ok" if records else "empty", len(records), names, told.get("as_of") if isinstance(told, dict) else None


def inventory(spark: SparkSession, folder: str, pattern: str = "*", envelope: str = "records") -> DataFrame:
    """path, bytes, modified, sha256, kind, state, rows, columns, declared_as_of of each file below folder.

    kind is the ending of the name.  Of csv, json and parquet the content is counted:
    state is ok, empty (a header or nothing), corrupt (it can't be read: broken text,
    rows of another width, no such format), or other_shape (JSON without a list of
    records); else the state is opaque.  A file of more than WHOLE bytes is read in
    blocks for its digest, through Arrow's file systems, and is large.  One that changes
    while it is read raises.  Hidden files (. and _) are left out, as Spark does; of a
    file of 0 bytes modified is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    listed = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    content = files.where(F.col("length") <= WHOLE).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    sent = content.unionByName(listed.where(F.col("bytes") > WHOLE).withColumn("content", F.lit(None).cast("binary")))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                path, size, modified, data = (row.column(c)[0].as_py() for c in range(4))
                kind, told = path.rsplit("/", 1)[-1].rpartition(".")[2].lower(), ("opaque", None, None, None)
                if data is None:
                    from pyarrow.fs import FileSystem

                    store, place = FileSystem.from_uri(path)
                    hashed, seen = hashlib.sha256(), 0
                    with store.open_input_stream(place) as stream:
                        while block := stream.read(BLOCK):
                            hashed.update(block)
                            seen += len(block)
                    told = ("large", None, None, None)
                else:
                    hashed, seen = hashlib.sha256(data), len(data)
                    if kind in ("csv", "json", "parquet"):
                        try:
                            told = _inspect(kind, data, envelope)
                        except (ValueError, csv.Error, OSError, pa.ArrowException):
                            told = ("corrupt", None, None, None)
                if seen != size:
                    raise ValueError(f"{path} changed while it was read: {size} and {seen} bytes")
                out = (path, size, modified, hashed.hexdigest(), kind, *told)
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(out, to_arrow_schema(shape))], schema=to_arrow_schema(shape))

    send_package(spark.sparkContext)
    shape: StructType = _parse_datatype_string(_INSPECTED)
    # Spark reads no files of 0 bytes, but has listed them
    every = spark.createDataFrame([(re.sub("^file:///", "file:/", unquote(p)),) for p in files.inputFiles()], "path string")
    hollow = every.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("timestamp").alias("modified"), F.lit(b"").alias("content"))
    # one file after the other; Arrow's batches would hold many contents at once
    return sent.unionByName(hollow).repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, shape)


def roots(spark: SparkSession, folder: str, names: list[str], pattern: str = "*") -> DataFrame:
    """root, present, files, bytes of each named folder below folder; one that is not there is told as such. folder itself must be there."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"{folder} is not there")
    there = {name: exists(spark, f"{folder}/{name}") for name in names}
    declared = spark.createDataFrame([(n, p) for n, p in there.items()], "root string, present boolean")
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(f"{folder}/{n}").select(F.lit(n).alias("root"), "length") for n, p in there.items() if p]
    if not parts:
        return declared.withColumns({"files": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
    held = reduce(DataFrame.unionByName, parts).groupBy("root").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return declared.join(held, "root", "left").fillna(0, ["files", "bytes"])


def strict_series(rows: DataFrame, entity, as_of: str, *, key: str = "entity", day: str = "trade_date", value: str = "close") -> DataFrame:
    """day and number of one entity's series at as_of, ascending; a cell that is no finite number or a bad date raises."""
    absent = {key, day, value} - set(rows.columns)
    if absent:
        raise ValueError(f"columns are missing: {sorted(absent)}")
    own = rows.where(F.col(key) == entity)
    number, at = F.col(value).cast("string").try_cast("double"), F.col(day).cast("string").try_cast("date")
    typed = own.select(at.alias(day), number.alias(value), F.col(value).alias("_raw"))
    fail_if_any(typed.where(F.col(day).isNull() | F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), "cells that can't be read")
    return typed.where(F.col(day) <= F.lit(as_of).cast("date")).select(day, value).orderBy(day)


def nested_documents(spark: SparkSession, path: str, record: str) -> tuple[DataFrame, DataFrame]:
    """JSON files {kind, as_of, records: [...]}: a row for each document with its count, and one for each record with its position."""
    docs = spark.read.schema(f"kind string, as_of date, records array<{record}>").option("multiLine", True).json(path)
    heads = docs.select("kind", "as_of", F.size("records").alias("n"))
    return heads, docs.select("kind", "as_of", F.posexplode("records").alias("position", "r")).select("kind", "as_of", "position", "r.*")
