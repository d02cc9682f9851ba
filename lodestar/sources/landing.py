"""Landing of tables: keyed merges, plans of what is missing, coverage, freshness, snapshots."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.tables import exists, replace, settle, store_of
from lodestar.sources import commits


def scan(spark: SparkSession, path: str, entities: list | None = None, start: str | None = None, end: str | None = None, *, key: str = "entity", day: str = "trade_date") -> DataFrame:
    """A Parquet table with optional filters, which reach the scan. A filter on a column that is not there raises."""
    df = spark.read.parquet(path)
    if entities is not None:
        df = df.where(F.col(key).isin(*entities))
    if start is not None:
        df = df.where(F.col(day) >= start)
    if end is not None:
        df = df.where(F.col(day) <= end)
    return df


def raw_csv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Text cells of a CSV, and the lines whose width is not the header's."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    df = settle(df, "raw-csv")
    return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null").select("_corrupt")


def single_value(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """The value that all rows agree on, else null: one row, or one for each of keys.

    A null is a value like any other, so rows of which some hold one do not agree; nor
    do rows that are not there, or a column that is not.
    """
    held = F.col(column) if column in df.columns else F.lit(None).cast("string")
    same = (F.min(held) == F.max(held)) & (F.count(held) == F.count("*"))
    return df.groupBy(*(keys or [])).agg(F.when(same, F.min(held)).alias(column))


def latest_partition(df: DataFrame, as_of: str, column: str) -> DataFrame:
    """Rows of the latest partition not later than as_of."""
    newest = df.where(F.col(column) <= F.lit(as_of).cast("date")).agg(F.max(column).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(column) == F.col("_newest"), "left_semi")


def _need_keys(keys: list[str], *tables: DataFrame) -> None:
    for df in tables:
        if absent := set(keys) - set(df.columns):
            raise ValueError(f"key columns are missing: {sorted(absent)}")


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """a joined with b, whose key columns are named _k0, _k1 and so on; null keys are equal."""
    return a.join(b, reduce(and_, [a[k].eqNullSafe(b[f"_k{n}"]) for n, k in enumerate(keys)]), how)


def _renamed(df: DataFrame, keys: list[str]) -> list[Column]:
    return [df[k].alias(f"_k{n}") for n, k in enumerate(keys)]


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of incoming's keys replaced, others appended; columns are the union of both, missing ones null.

    A null in a key is a key like any other.  Rows of incoming that share a key all stay.
    """
    _need_keys(keys, existing, incoming)
    kept = _null_safe(existing, incoming.select(*_renamed(incoming, keys)).distinct(), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merge_into(path: str, incoming: DataFrame, keys: list[str]) -> tuple[int, int]:
    """merge what stands at path, if anything, with incoming, and put it in its place: rows of incoming, and rows now there, both counted by the write itself."""
    spark = incoming.sparkSession
    written, total = Observation(), Observation()
    seen = incoming.observe(written, F.count("*").alias("n"))
    rows = merge(spark.read.parquet(path), seen, keys) if exists(spark, path) else seen
    replace(spark, path, rows.observe(total, F.count("*").alias("n")).write.parquet)
    return written.get["n"], total.get["n"]


def upsert(log: DataFrame, runs: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """log with runs taken in order: a run of a key that is there takes its row and keeps its position; others follow at the end of their group.

    log has position, from 0 in each group; runs have not.  Of runs of equal keys the
    last counts, at the place of the first.  Null keys are keys like any other.  A group
    has a row for each key, a few stages a day, so its new ones are numbered together.
    """
    _need_keys([group, *keys], log, runs)
    every = [group, *keys]
    columns = [c for c in log.columns if c != "position"]
    sent = runs.groupBy(*every).agg(F.max_by(F.struct(*columns), order).alias("_r"), F.min(order).alias("_first"))
    sent = sent.select("_r", "_first", *_renamed(sent, every))
    held = _null_safe(log.withColumn("_old", F.lit(True)), sent, every, "full_outer")
    of = F.coalesce(F.col(f"{group}"), F.col("_k0"))
    spread = Window.partitionBy("_of")
    fresh = F.row_number().over(Window.partitionBy("_of", F.col("_old").isNull()).orderBy("_first"))
    placed = held.withColumn("_of", of).withColumn("_next", F.coalesce(F.max("position").over(spread) + 1, F.lit(0)))
    position = F.coalesce("position", (F.col("_next") + fresh - 1).cast("long"))
    return placed.select(*[F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in columns], position.alias("position"))


def fold(parts: list[DataFrame]) -> DataFrame | None:
    """All parts as one table, columns in order of first sight; nothing gives None."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


#: Labels whose value names the entity, or else the board, that a block of text is about.
ENTITY_LABEL, BOARD_LABEL = "标的代码（统一输出字段名）", "板块代码"
#: Fixed value: a label and the word after its colon.
LABEL = r"(?U)\*\*([^*\n]+)\*\*\s*[:：]\s*(\S+)"


def block_identity(kind: Column, content: Column) -> Column:
    """What a block of text is about: its kind, and the entity that it names, else the board, else its whole content, of which a digest stands for it.

    Of equal labels the last counts.
    """
    found = F.arrays_zip(F.regexp_extract_all(content, F.lit(LABEL), F.lit(1)).alias("label"), F.regexp_extract_all(content, F.lit(LABEL), F.lit(2)).alias("value"))
    last = lambda label: F.try_element_at(F.filter(found, lambda x: x["label"] == label), F.lit(-1))["value"]
    text = F.coalesce(content, F.lit(""))
    return F.struct(F.coalesce(kind, F.lit("")).alias("kind"), F.coalesce(last(ENTITY_LABEL), last(BOARD_LABEL), F.concat(F.lit("sha256 "), F.sha2(text, 256))).alias("about"))


def newest_blocks(blocks: DataFrame, identity: Column) -> DataFrame:
    """Of blocks(batch, seq, ...) of equal identity the one of the newest batch, in order of first sight."""
    marked = blocks.withColumn("identity", identity)
    best = marked.groupBy("identity").agg(F.min(F.struct("batch", "seq")).alias("first_seen"), F.max_by(F.struct(*blocks.columns), F.struct("batch", "seq")).alias("b"))
    return best.select("identity", "first_seen", "b.*")


def merge_blocks(existing: DataFrame, incoming: DataFrame, kind: str = "type", content: str = "content") -> DataFrame:
    """existing with incoming's blocks of equal identity in the place of its own, others behind; position from first sight.

    Both have position.  Columns are incoming's, then those that only existing has.
    """
    columns = [c for c in [*incoming.columns, *(c for c in existing.columns if c not in incoming.columns)] if c != "position"]
    parts = [df.withColumns({"batch": F.lit(n), "seq": F.col("position")}).drop("position") for n, df in enumerate((existing, incoming))]
    merged = newest_blocks(parts[0].unionByName(parts[1], allowMissingColumns=True), block_identity(F.col(kind), F.col(content)))
    return merged.select(*columns, F.col("first_seen").alias("position"))


def missing(requested: DataFrame, landed: DataFrame, day: str, *, key: str = "entity", column: str = "trade_date") -> DataFrame:
    """Requested entities without a landed row on day."""
    return requested.select(key).join(landed.where(F.col(column) == F.lit(day).cast("date")).select(key), key, "left_anti").distinct()


def range_coverage(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Entities with a row at or before start and one at or after end."""
    spans = bars.groupBy("entity").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    return spans.where((F.col("first") <= F.lit(start).cast("date")) & (F.col("last") >= F.lit(end).cast("date"))).select("entity")


def sufficiency(bars: DataFrame, requested: DataFrame, as_of: str, needed: int, column: str = "close") -> DataFrame:
    """entity, n, enough: usable cells at as_of for every requested entity, 0 for those without rows."""
    counts = bars.where(F.col("trade_date") <= F.lit(as_of).cast("date")).groupBy("entity").agg(F.count(column).alias("n"))
    return requested.select("entity").distinct().join(counts, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= needed).alias("enough"))


def compact(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of parts whose manifest status is SUCCESS, or that have no entry."""
    joined = parts.join(manifest.select("part", F.col("status").alias("_s")), "part", "left")
    return joined.where("_s is null or _s = 'SUCCESS'").drop("_s")


def gap(requested: DataFrame, returned: DataFrame, key: str = "entity") -> DataFrame:
    """Entities asked for that the answer does not hold."""
    return requested.select(key).distinct().join(returned.select(key), key, "left_anti")


def gap_ledger(requested: DataFrame, landed: DataFrame, most: int | None = None) -> DataFrame:
    """round, requested, landed, missing, stop of a backfill's rounds, up to the one that ends it.

    landed: entity, round; a null entity marks a round that brought nothing.  A round
    asks for what is missing before it.  stop: no_progress (nothing new landed),
    max_rounds (it is the last of most) or covered (nothing is missing), else null.
    """
    wanted = requested.select("entity").distinct()
    total = wanted.agg(F.count("*").alias("_t"))
    first = landed.join(wanted, "entity", "left_semi").groupBy("entity").agg(F.min("round").alias("round"))
    counts = landed.select("round").distinct().join(first.groupBy("round").agg(F.count("*").alias("landed")), "round", "left").fillna(0, ["landed"])
    # as many rows as there were rounds
    order = Window.orderBy("round")
    missing = F.col("_t") - F.sum("landed").over(order)
    ran = counts.join(F.broadcast(total)).withColumn("missing", missing).withColumn("requested", F.col("missing") + F.col("landed")).withColumn("_k", F.row_number().over(order))
    last = F.lit(False) if most is None else F.col("_k") == most
    stop = F.when(F.col("landed") == 0, "no_progress").when(last, "max_rounds").when(F.col("missing") == 0, "covered")
    told = ran.withColumn("stop", stop).withColumn("_over", F.count("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return told.where("_over = 0").select("round", "requested", "landed", "missing", "stop")


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """dataset, n, first, last, unreadable of each table's date column."""
    parts = []
    for name, (df, column) in tables.items():
        day = F.col(column).cast("string").try_cast("date")
        parts.append(df.agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_if(day.isNull()).alias("unreadable")).select(F.lit(name).alias("dataset"), "*"))
    return reduce(DataFrame.unionByName, parts)


def fingerprint(df: DataFrame) -> DataFrame:
    """n, digest: content of a table, whatever the order of rows and columns."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(row).alias("mixed")).select("n", F.sha2(F.concat_ws(":", "n", "total", "mixed"), 256).alias("digest"))


def write_snapshot(df: DataFrame, folder: str, kind: str, as_of: str) -> str:
    """Write df as the snapshot of kind and as_of: 'written', or 'same' if equal content is there. Different content raises; nothing is overwritten.

    Of several writers at once one is first; the others get 'same' or the error, as if
    they had come later.  A writer that dies leaves no snapshot, and bars nobody.
    """
    spark, path = df.sparkSession, f"{folder}/kind={kind}/as_of={as_of}"
    held = commits.current(spark, path)
    if held is None:
        part = commits.stage(df, path, "data")
        own = fingerprint(spark.read.parquet(f"{path}/{part}")).first().digest
        if commits.create(spark, path, {"data": part}, digest=own):
            return "written"
        store, place = store_of(spark, f"{path}/{part}")
        store.delete(place, True)
        held = commits.current(spark, path)
    else:
        own = fingerprint(df).first().digest
    if held["digest"] != own:
        raise ValueError(f"a different snapshot of {kind} at {as_of} is there")
    return "same"


def snapshot_days(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """The days that have a snapshot of kind, in order: names of folders, a row for each day in a list."""
    store, place = store_of(spark, f"{folder}/kind={kind}")
    if not store.exists(place):
        return []
    days = [f.getPath().getName().removeprefix("as_of=") for f in store.listStatus(place) if f.isDirectory()]
    return sorted(d for d in days if exists(spark, f"{folder}/kind={kind}/as_of={d}/{commits.CURRENT}"))


def published(spark: SparkSession, folder: str, kinds: list[str]) -> DataFrame:
    """kind, as_of of every snapshot that is there, of the given kinds: names of folders, few for each day."""
    rows = [(k, d) for k in kinds for d in snapshot_days(spark, folder, k)]
    return spark.createDataFrame(rows, "kind string, as_of string").withColumn("as_of", F.col("as_of").cast("date"))


def equivalence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """check, a_value, b_value, same: rows, duplicate keys, nulls and zeros of each column, rows only on one side."""
    columns = [c for c in a.columns if c in b.columns]
    kinds = dict(a.dtypes)

    def measures(df: DataFrame) -> DataFrame:
        items = [F.count("*").alias("rows")] + [F.count_if(F.col(c).isNull()).alias(f"nulls.{c}") for c in columns] + [F.count_if(F.col(c) == 0).alias(f"zeros.{c}") for c in columns if kinds[c] in ("int", "bigint", "double", "float")]
        counts = df.agg(*items)
        doubled = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))
        wide = counts.join(F.broadcast(doubled))
        return wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "check", "value")

    both = measures(a).withColumnRenamed("value", "a_value").join(measures(b).withColumnRenamed("value", "b_value"), "check")
    only = a.select(*columns).exceptAll(b.select(*columns)).agg(F.count("*").alias("a_value")).join(F.broadcast(b.select(*columns).exceptAll(a.select(*columns)).agg(F.count("*").alias("b_value"))))
    every = both.unionByName(only.withColumn("check", F.lit("rows_only_here")))
    return every.withColumn("same", F.col("a_value") == F.col("b_value"))


def append_ledger(ledger: DataFrame, records: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """New records to append, each once, and conflicts: ids known with different content, or sent with more than one."""
    content = lambda df: F.xxhash64(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}))
    known = ledger.select(key, content(ledger).alias("_old"))
    sent = records.withColumn("_new", content(records)).groupBy(key).agg(F.first(F.struct(*records.columns)).alias("_r"), F.min("_new").alias("_least"), F.max("_new").alias("_most"))
    joined = sent.join(known, key, "left")
    clash = (F.col("_least") != F.col("_most")) | (F.coalesce(F.col("_old"), F.col("_least")) != F.col("_least"))
    return joined.where(F.col("_old").isNull() & ~clash).select("_r.*"), joined.where(clash).select(key)


def history(ledger: DataFrame, column: str, value, at: str) -> DataFrame:
    """The records whose column is value, in order of at."""
    return ledger.where(F.col(column) == value).orderBy(at)


def write_compacted(parts: DataFrame, manifest: DataFrame, path: str, keys: list[str]) -> None:
    """The rows of compact as Parquet, cut in ranges of keys and sorted by them, so that a reader of one key skips the others' files and row groups."""
    rows = compact(parts, manifest).repartitionByRange(*keys).sortWithinPartitions(*keys)
    replace(parts.sparkSession, path, rows.write.parquet)
