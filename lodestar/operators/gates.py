"""Data-quality gates over bars and observations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rules of the bar gate, their severity and the state of the data.
SEVERITY = {"close_missing": "P2", "close_not_positive": "P2", "volume_negative": "P2", "duplicate_primary_key": "P2", "dataset_empty": "P1"}


def bar_issues(bars: DataFrame) -> DataFrame:
    """entity, trade_date, rule: every defect of every bar; an empty table is one issue."""
    copies = F.count("*").over(Window.partitionBy("entity", "trade_date"))
    checks = {"close_missing": F.col("close").isNull(), "close_not_positive": F.col("close") <= 0, "volume_negative": F.col("volume") < 0, "duplicate_primary_key": F.col("_n") > 1}
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in checks.items()]))
    issues = bars.withColumn("_n", copies).select("entity", "trade_date", F.explode(found).alias("rule"))
    empty = bars.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(bars.schema["entity"].dataType).alias("entity"), F.lit(None).cast("date").alias("trade_date"), F.lit("dataset_empty").alias("rule"))
    return issues.unionByName(empty)


def valid_bars(bars: DataFrame, issues: DataFrame) -> DataFrame:
    """bars without any row of a flagged key; all copies of a duplicate go."""
    return bars.join(issues.select("entity", "trade_date").distinct(), ["entity", "trade_date"], "left_anti")


def observation_issues(rows: DataFrame, failures: DataFrame, key: tuple[str, ...] = ("entity", "metric", "report_period")) -> DataFrame:
    """key, rule, state: duplicates and unreadable cells are INVALID, missing values only NULL."""
    keyed = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    unread = failures.select(*key).distinct().withColumn("_f", F.lit(True))
    joined = keyed.join(unread, list(key), "left")
    rule = F.when(F.col("_n") > 1, "duplicate_primary_key").when(F.col("_f"), "cell_unreadable").when(F.col("value").isNull(), "value_missing")
    state = F.when((F.col("_n") > 1) | F.col("_f"), "INVALID").otherwise("NULL")
    return joined.select(*key, rule.alias("rule"), state.alias("state")).where("rule is not null").distinct()


def usable_observations(rows: DataFrame, issues: DataFrame, key: tuple[str, ...] = ("entity", "metric", "report_period")) -> DataFrame:
    return rows.join(issues.where("state = 'INVALID'").select(*key), list(key), "left_anti")


def look_ahead(rows: DataFrame, as_of: str, known: str = "announce_date") -> DataFrame:
    """n: rows that were not known at as_of; must be 0 after the visibility filter."""
    return rows.agg(F.count_if(F.col(known) > F.lit(as_of).cast("date")).alias("n"))


def known_at(rows: DataFrame, as_of: str, known: str, keys: list[str]) -> DataFrame:
    """rows, which raise where they are read or written if one was known only after as_of, or at no time: the error names its keys.

    as_of is a time with its zone.  known is a timestamp, or text of one with its zone;
    text without a zone raises as well, and a column of dates or of times without a zone
    is refused at once.
    """
    zone = r"T?.*(Z|[+-]\d{2}:?\d{2})$"
    if not re.search(zone, as_of):
        raise ValueError(f"{as_of} has no zone")
    kind = rows.schema[known].dataType.simpleString()
    if kind not in ("timestamp", "string"):
        raise ValueError(f"{known} is a {kind}, which has no zone")
    moment = F.col(known).try_cast("timestamp")
    naive = ~F.col(known).rlike(zone) if kind == "string" else F.lit(False)
    told = F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys], F.coalesce(F.col(known).cast("string"), F.lit("null")))
    wrong = F.when(moment.isNull(), "not a time").when(naive, "a time without a zone").when(moment > F.lit(as_of).cast("timestamp"), f"known after {as_of}")
    stop = F.raise_error(F.concat(told, F.lit(": "), wrong)).cast("boolean")
    # a filter is never pruned, so the rows cannot be used without the check
    return rows.where(F.when(wrong.isNotNull(), stop).otherwise(True))


def by_severity(issues: DataFrame) -> DataFrame:
    """severity, n, blocking."""
    named = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return issues.groupBy(named[F.col("rule")].alias("severity")).agg(F.count("*").alias("n")).withColumn("blocking", F.col("severity").isin("P0", "P1"))
