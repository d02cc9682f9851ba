"""Checks of stored results that know nothing of how they were made: each gives findings, a row for each offence."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outside(df: DataFrame, column: str, low: float, high: float, rule: str) -> DataFrame:
    """Rows whose column lies outside low to high; null is fine."""
    return df.where((F.col(column) < low) | (F.col(column) > high)).withColumn("rule", F.lit(rule))


def without(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Rows where one of the required keys is null."""
    return df.where(reduce(or_, [F.col(k).isNull() for k in keys])).withColumn("rule", F.lit(rule))


def blank(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Rows whose text column is null or empty."""
    return df.where(F.trim(F.coalesce(column, F.lit(""))) == "").withColumn("rule", F.lit(rule))


def late(df: DataFrame, column: str, as_of: str, rule: str) -> DataFrame:
    """Rows that were known only after as_of; null is fine."""
    return df.where(F.col(column) > F.lit(as_of).cast("date")).withColumn("rule", F.lit(rule))


def unknown(df: DataFrame, column: str, vocabulary: DataFrame, rule: str) -> DataFrame:
    """Rows whose column is not in the vocabulary."""
    return df.join(vocabulary.select(F.col(vocabulary.columns[0]).alias(column)).distinct(), column, "left_anti").withColumn("rule", F.lit(rule))


def dangling(cited: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Citations of something that is not stored."""
    return cited.join(stored.select(*keys), keys, "left_anti")


def counted(findings: DataFrame, rules: list[str]) -> DataFrame:
    """rule, n for every rule, also those without findings."""
    every = findings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
    return every.join(findings.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def candidate_findings(chosen: DataFrame, qualified: DataFrame, cap: int) -> DataFrame:
    """rule, n: more than cap rows, an entity twice, a vetoed state, or a primary strategy that the entity is not qualified for."""
    passed = qualified.where("qualified").select("entity", F.col("strategy").alias("primary_strategy"))
    parts = [
        chosen.agg(F.count("*").alias("n")).where(F.col("n") > cap).select(F.lit("CAP").alias("rule")),
        chosen.groupBy("entity").count().where("count > 1").select(F.lit("DUPLICATE").alias("rule")),
        chosen.where("validation = 'CONTRADICTED' or signal = 'BREAKDOWN'").select(F.lit("VETOED").alias("rule")),
        chosen.join(passed, ["entity", "primary_strategy"], "left_anti").select(F.lit("PRIMARY").alias("rule")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return counted(every, ["CAP", "DUPLICATE", "VETOED", "PRIMARY"])


#: Rules of a manifest.
MANIFEST = ("UNKNOWN_STAGE", "DUPLICATE_STAGE", "MISSING_STAGE", "STATUS", "FINISHED", "ERROR", "TIME")
#: States of a run.
ENDED, TROUBLED = ("SUCCESS", "FAILED", "BLOCKED"), ("FAILED", "BLOCKED")


def manifest_findings(log: DataFrame, stages: list[str]) -> DataFrame:
    """rule, n over the manifests of log: day, stage, status, started_at, finished_at, error.

    Of each run: a stage or a status that is not known; an end that a running one has
    or an ended one lacks; an error that a troubled one lacks or another has; no start,
    or an end before it.  Of each day: a stage again (each time after the first), and
    stages that never ran.
    """
    status, ends = F.col("status"), F.col("finished_at").isNotNull()
    failed = F.trim(F.coalesce("error", F.lit(""))) != ""
    known = F.coalesce(status.isin(*ENDED, "RUNNING"), F.lit(False))
    rules = {
        "UNKNOWN_STAGE": F.col("stage").isNotNull() & ~F.col("stage").isin(*stages),
        "STATUS": ~known,
        "FINISHED": known & (ends == (status == "RUNNING")),
        "ERROR": known & (failed != status.isin(*TROUBLED)),
        "TIME": F.col("started_at").isNull() | F.coalesce(F.col("finished_at") < F.col("started_at"), F.lit(False)),
    }
    runs = log.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    # per day, one row for each stage of its log; the known stages are a fixed list
    held = log.groupBy("day", "stage").agg(F.count("*").alias("k"))
    again = held.where("stage is not null and k > 1").select(F.lit("DUPLICATE_STAGE").alias("rule"), (F.col("k") - 1).alias("n"))
    days = held.groupBy("day").agg(F.collect_set(F.when(F.col("stage").isin(*stages), F.col("stage"))).alias("there"))
    absent = days.select(F.lit("MISSING_STAGE").alias("rule"), (F.lit(len(stages)) - F.size("there")).cast("long").alias("n"))
    counts = runs.groupBy("rule").agg(F.count("*").alias("n")).unionByName(again).unionByName(absent).groupBy("rule").agg(F.sum("n").alias("n"))
    every = log.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in MANIFEST])).alias("rule"))
    return every.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def uncited(cited: DataFrame, column: str, declared: str) -> DataFrame:
    """cited with bad: whether its version is not among the declared ones, a comma-joined set."""
    return cited.withColumn("bad", ~F.array_contains(F.split(F.lit(declared), ","), F.col(column)))
