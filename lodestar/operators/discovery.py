"""Reads of stored results: screens, coverage, overview, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.reports import impact


def screen(results: DataFrame, strategy: str, *, eligible_only: bool = True, least: float | None = None, limit: int = 50) -> DataFrame:
    """rank and the first limit rows of a strategy: percentile, then score, then entity. The rank is made over the rows that are left."""
    rows = results.where(F.col("strategy") == strategy)
    if eligible_only:
        rows = rows.where("eligible")
    if least is not None:
        rows = rows.where(F.col("rank_percentile") >= least)
    order = (F.col("rank_percentile").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("entity"))
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def coverage(results: DataFrame) -> DataFrame:
    """strategy, total, eligible, scored, ranked."""
    return results.groupBy("strategy").agg(F.count("*").alias("total"), F.count_if("eligible").alias("eligible"), F.count("score").alias("scored"), F.count("rank_percentile").alias("ranked"))


def low_coverage(covered: DataFrame, least: float) -> DataFrame:
    return covered.select("strategy", (F.col("scored") / F.col("total") < least).alias("low"))


def qualified_screen(qualified: DataFrame, strategy: str, limit: int) -> DataFrame:
    return qualified.where((F.col("strategy") == strategy) & F.col("qualified")).orderBy(F.desc("rank_percentile"), "entity").limit(limit)


def qualified_coverage(results: DataFrame, qualified: DataFrame) -> DataFrame:
    """strategy, eligible, ranked, top, absolute, both, and a warning where none qualified."""
    counts = impact(results, qualified)
    text = F.format_string("%s: none qualified of %d eligible and %d ranked; check coverage and quality", "strategy", "eligible", "ranked")
    return counts.withColumn("warning", F.when(F.col("both") == 0, text))


def candidate_screen(chosen: DataFrame, limit: int) -> DataFrame:
    """The stored order, with all qualified strategies as text and the best percentile to four places."""
    return chosen.orderBy("position").limit(limit).withColumn("strategies", F.array_join("strategies", ",")).withColumn("best", F.round("best", 4))


def overview(chosen: DataFrame, regime: DataFrame, top: int = 10) -> DataFrame:
    """kind, key, n: all, counts by primary strategy, validation and signal, the first top entities with their position, and the regime."""
    fields = (("primary", "primary_strategy", "unassigned"), ("validation", "validation", "NONE"), ("signal", "signal", "NO_SIGNAL"))
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(c), F.lit(none)).alias("key")) for kind, c, none in fields])
    counts = chosen.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    total = chosen.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("candidates").alias("key"), "n")
    first = chosen.where(F.col("position") <= top).select(F.lit("top").alias("kind"), F.col("entity").cast("string").alias("key"), F.col("position").cast("long").alias("n"))
    return counts.unionByName(total).unionByName(first).unionByName(regime.select(F.lit("regime").alias("kind"), F.col("regime").alias("key"), F.lit(1).cast("long").alias("n")))


def dates(rows: DataFrame, column: str) -> DataFrame:
    """day, latest: the days that are stored, and which is the last."""
    days = rows.select(F.col(column).alias("day")).where("day is not null").distinct()
    return days.join(F.broadcast(days.agg(F.max("day").alias("_last")))).select("day", (F.col("day") == F.col("_last")).alias("latest"))


def profiles(universe: DataFrame, panel: DataFrame, results: DataFrame, qualified: DataFrame, chosen: DataFrame | None, tracked: DataFrame) -> DataFrame:
    """entity, included, n_values, factors, ranked_in, qualified_for, status, tracking.

    factors: name, status and value of each, ordered.  chosen: the day's candidates, None if
    none were published.  tracked: entity, state.
    """
    values = panel.groupBy("entity").agg(F.count_if(F.col("status") == "VALUE").alias("n_values"), F.sort_array(F.collect_list(F.struct("factor", "status", "raw_value"))).alias("factors"))
    ranked = results.where("rank_percentile is not null").groupBy("entity").agg(F.sort_array(F.collect_list("strategy")).alias("ranked_in"))
    passed = qualified.where("qualified").groupBy("entity").agg(F.sort_array(F.collect_list("strategy")).alias("qualified_for"))
    rows = universe.join(values, "entity", "left").join(ranked, "entity", "left").join(passed, "entity", "left").join(tracked.select("entity", F.col("state").alias("tracking")), "entity", "left")
    if chosen is None:
        rows = rows.withColumn("status", F.lit("not_published"))
    else:
        rows = rows.join(chosen.select("entity", F.lit("published").alias("status")), "entity", "left")
    return rows.select("entity", "included", F.coalesce("n_values", F.lit(0)).alias("n_values"), "factors", "ranked_in", "qualified_for", F.coalesce("status", F.lit("not_selected")).alias("status"), "tracking")
