"""Candidate selection: vetoes, a reserve for each strategy, a capped fill in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import fail_if_any

RESERVE, CAP = 3, 50


def assemble(qualified: DataFrame, validated: DataFrame) -> DataFrame:
    """entity, best, n_qualified, strategies, validation, signal of entities with a qualified strategy; missing evidence raises."""
    each = qualified.where("qualified").groupBy("entity").agg(F.max("rank_percentile").alias("best"), F.count("*").alias("n_qualified"), F.sort_array(F.collect_list("strategy")).alias("strategies"))
    rows = each.join(validated.select("entity", "strategy", "validation", "signal"), "entity", "left").withColumnRenamed("strategy", "primary_strategy")
    fail_if_any(rows.where("validation is null or signal is null").select("entity"), "candidates without evidence")
    return rows


def without_vetoed(rows: DataFrame) -> DataFrame:
    return rows.where("validation <> 'CONTRADICTED' and signal <> 'BREAKDOWN'")


def reserve(rows: DataFrame, qualified: DataFrame, each: int = RESERVE) -> DataFrame:
    """Entities among the best of some strategy, by its own percentile and then by entity."""
    order = Window.partitionBy("strategy").orderBy(F.desc("rank_percentile"), "entity")
    inside = qualified.where("qualified").join(rows.select("entity"), "entity", "left_semi")
    return inside.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= each).select("entity").distinct()


def select(rows: DataFrame, qualified: DataFrame, *, each: int = RESERVE, cap: int = CAP) -> DataFrame:
    """rows chosen, with position: the reserve always, the rest in order of priority up to cap.

    Only rows that can be chosen meet in one task: those of the reserve, and the
    first cap of the others.
    """
    live = without_vetoed(rows)
    kept = live.join(reserve(live, qualified, each).withColumn("is_reserve", F.lit(True)), "entity", "left").withColumn("is_reserve", F.coalesce("is_reserve", F.lit(False)))
    key = (F.desc("best"), F.desc("n_qualified"), (F.col("validation") == "CONFIRMED").cast("int").desc(), F.col("entity"))
    held = kept.where("is_reserve")
    n = held.agg(F.count("*").alias("n_reserve"))
    others = kept.where("not is_reserve").orderBy(*key).limit(cap)
    filled = others.withColumn("rn", F.row_number().over(Window.orderBy(*key))).join(F.broadcast(n)).where(F.col("rn") <= cap - F.col("n_reserve")).drop("rn", "n_reserve")
    return held.unionByName(filled).withColumn("position", F.row_number().over(Window.orderBy(*key)))


def build(chosen: DataFrame) -> DataFrame:
    """chosen with action, reasons and risks."""
    reasons = F.transform("strategies", lambda s: F.concat(F.lit("qualified for "), s))
    risks = F.when(F.col("signal") == "TREND_WEAKEN", F.array(F.lit("trend weakens"))).otherwise(F.array().cast("array<string>"))
    return chosen.withColumn("action", F.lit("WATCH")).withColumn("reasons", reasons).withColumn("risks", risks)


def route(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """entity, action: WATCH if chosen, else IGNORE."""
    return rows.select("entity").join(chosen.select("entity", F.lit("WATCH").alias("action")), "entity", "left").fillna("IGNORE", ["action"])
