"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page id in ranges of about equal bytes.  The ranges follow
from sums of bytes over the sorted ids, not from samples, so every run makes the
same files.  An id that holds more than its range is split by digest.  A range's
file rolls over at a compressed size.  A task writes to a temporary name, then
renames to a name that depends on range and number only; a repeated task writes
the same bytes to the same name.  Readers go by the manifest, which Spark commits
as a table once all files are there; temporary files of lost tasks are removed then.

Of records with equal payloads the one with the largest id is a response; the
others revisit it and store no payload.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import math
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.rows import map_rows
from lodestar.llm.shared import fresh_path, settle

#: Payloads below this size are never revisits.
LEAST = 1000
#: Bytes of payload in a range, and compressed bytes at which a file rolls over.
RANGE_BYTES, ROLL_BYTES = 16 << 20, 8 << 20
#: Ranges at most, so that what the driver holds of them and sends to the tasks is bounded.
MOST_RANGES = 1 << 16
#: The date of all records, so that reruns agree.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    """A file system and the path in it, for a local path or any store that pyarrow knows."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return None, parts.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def _open(uri: str, mode: str):
    store, path = _store(uri)
    if store is None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode) as f:
            yield f
    elif mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as f:
            yield f
    else:
        with store.open_input_stream(path) as f:
            yield f


def _rename(old: str, new: str) -> None:
    """A file of the new name has the same bytes, from another attempt; it is replaced or stays."""
    store, path = _store(old)
    target = _store(new)[1]
    if store is None:
        os.replace(path, target)
        return
    try:
        store.move(path, target)
    except OSError:
        if store.get_file_info(target).size != store.get_file_info(path).size:
            raise
        store.delete_file(path)


def _remove(folder: str) -> None:
    store, path = _store(folder)
    if store is None:
        shutil.rmtree(path, ignore_errors=True)
    else:
        with contextlib.suppress(OSError):
            store.delete_dir(path)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record with new headers and digests."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]+", "%20", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without a time."""
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class _Writer:
    """Writes the records of a task, which come sorted by task, id and digest."""

    def __init__(self, folder: str, roll: int):
        self.folder, self.roll, self.task, self.shard, self.number, self.file = folder, roll, None, None, 0, None
        self.mark: tuple = ()

    def __call__(self, task: int, shard: int, page_id: int | None, key: str, url: str | None, payload: bytes | None, response: int | None) -> Iterator[tuple]:
        if payload is None:  # a mark stands before the records that it makes revisits
            self.mark = page_id, key, response
            return
        refers_to = self.mark[2] if self.mark[:2] == (page_id, key) else None
        if task != self.task:
            yield from self.finish()
            self.task, self.shard, self.number = task, shard, 0
        if self.file is None:
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
            self.stack = contextlib.ExitStack()
            self.file = self.stack.enter_context(_open(self.temporary, "wb"))
            self.digest, self.records, self.size = hashlib.sha256(), 0, 0
        data = _member(record(page_id, url, payload, refers_to))
        self.file.write(data)
        self.digest.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.roll:
            yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        if self.file is not None:
            self.stack.close()
            name = f"range-{self.shard:08d}-{self.task:08d}-{self.number:05d}.warc.gz"
            _rename(self.temporary, f"{self.folder}/{name}")
            self.file, self.number = None, self.number + 1
            yield f"{self.folder}/{name}", self.shard, self.task, self.records, self.size, self.digest.hexdigest()


def _cuts(rows: DataFrame, range_bytes: int) -> tuple[list[float], list[tuple]]:
    """Where ranges of ids begin, by sums of bytes over the sorted ids, and the ids that hold more than a range: id and bytes.

    Both lists are bounded by MOST_RANGES.  An id's sum before it is that within its
    sorted partition plus the partitions before, of which one row each meets in a task.
    """
    place = F.monotonically_increasing_id()
    by_id = rows.groupBy("page_id").agg(F.sum("size").alias("bytes"))
    ordered = settle(by_id.orderBy(F.col("page_id").asc_nulls_first()).withColumn("place", place), "warc-ids")
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    totals = ordered.groupBy("part").agg(F.sum("bytes").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = F.sum("bytes").over(Window.partitionBy("part").orderBy("place")) - F.col("bytes")
    placed = settle(ordered.withColumn("own", own).join(before, "part").select("page_id", "bytes", F.floor((F.col("own") + F.col("before")) / F.lit(range_bytes)).alias("range")), "warc-placed")
    first = placed.where(F.col("page_id").isNotNull()).groupBy("range").agg(F.min("page_id").cast("double").alias("at")).collect()
    heavy = placed.where(F.col("bytes") > 2 * range_bytes).select("page_id", "bytes").collect()
    return sorted({r.at for r in first})[1:], sorted(((r.page_id, r.bytes) for r in heavy), key=lambda x: (x[0] is not None, x[0] or 0))


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Write pages as archives under folder. The manifest: file, range, part, records, bytes, sha256.

    Null html: an empty payload.  Null ids come first.  Rows that share the largest
    id of equal payloads are responses all.  Repeated rows are repeated records.
    An empty table writes no file.  At most about most_ranges ranges are cut, so
    they grow beyond range_bytes where the pages are larger than both allow.  An id
    of more than two ranges is split by digest, and a digest of that size by place
    in the input.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    slim = settle(rows.select("page_id", F.sha1("payload").alias("key"), F.octet_length("payload").cast("long").alias("size")), "warc-slim")
    same = slim.where(F.col("size") >= LEAST).groupBy("key", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    # payloads move once: revisits are found in a table of digests and sent along as marks, which sort before their records
    marks = slim.where(F.col("size") >= LEAST).join(same, ["key", "size"]).where(~F.col("page_id").eqNullSafe(F.col("response"))).select("page_id", "key", "response").distinct()

    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    range_bytes = max(range_bytes, -(-total // most_ranges))
    cuts, heavy = _cuts(slim, range_bytes)
    ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="bucket") if cuts else None
    # tasks: one for each range, null ids first, then those of each heavy id, and for each digest that is heavy in it
    n = len(cuts) + 2
    parts, many = [], []
    for page_id, held in heavy:
        parts.append((page_id, n, m := -(-held // range_bytes)))
        n += m
    parts_of = F.broadcast(spark.createDataFrame(parts, "_id long, _first int, _parts int"))
    if heavy:
        among = slim.join(parts_of, F.col("page_id").eqNullSafe(F.col("_id"))).groupBy("page_id", "key").agg(F.sum("size").alias("held")).where(F.col("held") > 2 * range_bytes).collect()
        for r in sorted(among, key=lambda r: (r.page_id is not None, r.page_id or 0, r.key)):
            many.append((r.page_id, r.key, n, m := -(-r.held // range_bytes)))
            n += m
    many_of = F.broadcast(spark.createDataFrame(many, "_i long, _k string, _start int, _copies int"))

    def dealt(df: DataFrame, copy: Column) -> DataFrame:
        """df with shard and task. copy: to which of the _copies tasks of a heavy digest a row goes."""
        df = df.withColumn("at", F.coalesce(F.col("page_id").cast("double"), F.lit(0.0)))
        df = ranges.transform(df) if ranges else df.withColumn("bucket", F.lit(0.0))
        shard = F.when(F.col("page_id").isNull(), 0).otherwise(F.col("bucket").cast("int") + 1)
        df = df.withColumn("shard", shard).drop("at", "bucket").join(parts_of, F.col("page_id").eqNullSafe(F.col("_id")), "left")
        df = df.join(many_of, F.col("page_id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left")
        digest = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("_parts") / F.lit(1 << 32)).cast("int")
        df = df.withColumn("_copy", copy)
        return df.withColumn("task", F.coalesce(F.col("_start") + F.col("_copy"), F.col("_first") + digest, "shard")).drop("_id", "_first", "_parts", "_i", "_k", "_start", "_copies", "_copy")

    blank = F.lit(None)
    record_rows = rows.select("page_id", F.sha1("payload").alias("key"), F.lit(1).alias("kind"), "url", "payload", blank.cast("long").alias("response"))
    record_rows = dealt(record_rows, F.pmod(F.monotonically_increasing_id(), F.col("_copies")).cast("int"))
    # a mark goes to all tasks of its digest
    mark_rows = marks.select("page_id", "key", F.lit(0).alias("kind"), blank.cast("string").alias("url"), blank.cast("binary").alias("payload"), "response")
    mark_rows = dealt(mark_rows, F.explode(F.expr("sequence(0, coalesce(_copies, 1) - 1)"))) if many else dealt(mark_rows, F.lit(0))
    ordered = record_rows.unionByName(mark_rows).repartitionById(n, F.col("task")).sortWithinPartitions("task", F.col("page_id").asc_nulls_first(), "key", "kind", "url")
    made = map_rows(ordered, ["task", "shard", "page_id", "key", "url", "payload", "response"], "file string, range long, part long, records long, bytes long, sha256 string", lambda: _Writer(folder, roll_bytes))
    made.write.parquet(f"{folder}/_manifest")
    _remove(f"{folder}/_temporary")
    return spark.read.schema(made.schema).parquet(f"{folder}/_manifest")


def read_records(file) -> Iterator[tuple]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of an open archive; digests are checked."""
    unzipped = gzip.GzipFile(fileobj=file)
    while line := unzipped.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record that does not begin with its version")
        head = {}
        while (line := unzipped.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = unzipped.read(int(head["content-length"]))
        if _sha1(block) != head["warc-block-digest"]:
            raise ValueError(f"the block of {head['warc-record-id']} is damaged")
        http, _, payload = block.partition(b"\r\n\r\n")
        number = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x)) else None
        declared = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        digest = head["warc-payload-digest"]
        revisit = head["warc-type"] == "revisit"
        if not revisit and (_sha1(payload) != digest or len(payload) != declared):
            raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
        bare = base64.b32decode(digest.partition(":")[2]).hex()
        yield number(head["warc-record-id"]), head.get("warc-target-uri"), declared, bare, head["warc-type"], number(head["warc-refers-to"]) if revisit else None


def read(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to: one row for each record of the manifest's files."""

    def row(uri: str) -> Iterator[tuple]:
        with _open(uri, "rb") as file:
            yield from read_records(file)

    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    return map_rows(files, ["file"], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long", lambda: row)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """What the archives of pages hold, read back; they are written to a new folder of the shared one."""
    return read(write(pages, fresh_path(pages.sparkSession, "warc"), **options))


#: The same in DuckDB's SQL.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, payload_bytes, max(page_id) as response from p where payload_bytes >= 1000 group by all having count(*) > 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when response is null or page_id = response then 'response' else 'revisit' end as record_type, case when page_id = response then null else response end as refers_to
from p left join m using (payload_digest, payload_bytes)
"""
