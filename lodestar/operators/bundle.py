"""All that a day's factors read, from the raw tables that have landed; what has not is named."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.tables import exists, settle
from lodestar.operators import gates, normalize

#: Columns of the raw tables, as text, beside row.
BARS = ("open", "high", "low", "close", "volume", "amount")


@dataclass(frozen=True)
class Bundle:
    """Typed and gated rows of one as_of.

    absent lists the datasets that never landed, or have no row; one that landed without a
    usable row is not among them.  failures: dataset, row, column, cell, reason.  issues: the
    gate's findings of bars.  pending: dataset, n rows not yet known.
    """

    as_of: str
    bars: DataFrame
    securities: DataFrame | None
    observations: DataFrame | None
    failures: DataFrame
    issues: DataFrame
    pending: DataFrame
    absent: tuple[str, ...]


def _landed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The raw rows of a dataset at root/name.parquet; None if it never landed or is empty."""
    path = f"{root}/{name}.parquet"
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    return None if df.isEmpty() else df


def assemble(spark: SparkSession, root: str, as_of: str, statements: dict[str, dict[str, tuple[str, str]]]) -> Bundle:
    """The bundle of as_of, a time, from root: bars, which must be there, securities, and the named statements with their metrics (column to metric and unit)."""
    raw = _landed(spark, root, "bars")
    if raw is None:
        raise FileNotFoundError(f"{root} has no bars")
    early = normalize.available_at(F.col("_day"), "UTC") <= F.lit(as_of).cast("timestamp")
    # cells are parsed once: bars, issues and failures read what is settled
    typed, failures = normalize.bars(raw, list(BARS), lambda parsed: settle(parsed.withColumn("_early", early), "bundle-bars"))
    known = typed.where("_early").drop("_early")
    issues = settle(gates.bar_issues(known), "bundle-issues")
    told, absent, pending, observed, securities = [failures.withColumn("dataset", F.lit("bars"))], [], [], [], None
    dimension = _landed(spark, root, "securities")
    if dimension is None:
        absent.append("securities")
    else:
        securities, failures = normalize.securities(dimension)
        told.append(failures.withColumn("dataset", F.lit("securities")))
    for name in sorted(statements):
        rows = _landed(spark, root, name)
        if rows is None:
            absent.append(name)
            continue
        found, failures, later, _ = normalize.statements(rows, statements[name], as_of)
        found = settle(found, "bundle-observations")
        doubts = gates.observation_issues(found, found.limit(0).select("entity", "metric", "report_period"))
        observed.append(gates.usable_observations(found, doubts).withColumn("dataset", F.lit(name)))
        told.append(failures.withColumn("dataset", F.lit(name)))
        pending.append(later.select(F.lit(name).alias("dataset"), F.col("pending").alias("n")))
    columns = ["dataset", "row", "column", "cell", "reason"]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    waiting = union(pending) if pending else spark.createDataFrame([], "dataset string, n long")
    return Bundle(as_of, gates.valid_bars(known, issues), securities, union(observed) if observed else None, union([t.select(*columns) for t in told]), issues, waiting, tuple(absent))
