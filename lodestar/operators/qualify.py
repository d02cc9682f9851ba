"""The dual gate: a percentile within the strategy and absolute limits on factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.columns import VALUE, fail_if_any

LEAST_PERCENTILE = 0.90

#: Strategy, factor, least and most, both included.
THRESHOLDS = (
    ("value", "pe_ttm", None, 25.0), ("value", "pb", None, 2.5), ("value", "roe_ttm", 5.0, None),
    ("growth", "net_profit_parent_yoy", 15.0, None), ("growth", "revenue_yoy", 5.0, None), ("growth", "roe_ttm", 8.0, None),
    ("garp", "pe_ttm", None, 35.0), ("garp", "net_profit_parent_yoy", 15.0, None), ("garp", "roe_ttm", 10.0, None),
    ("quality", "roe_ttm", 12.0, None), ("quality", "gross_margin", 20.0, None), ("quality", "debt_to_asset", None, 65.0),
    ("dividend", "dividend_yield_ttm", 3.0, None), ("dividend", "dividend_payout_ttm", 0.10, 0.80),
    ("momentum", "proximity_52w_high", 0.80, None),
)


def thresholds(spark: SparkSession, rows=THRESHOLDS) -> DataFrame:
    """strategy, factor, low, high, pos."""
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "strategy string, factor string, low double, high double, pos int")


def absolute(ranked: DataFrame, panel: DataFrame, limits: DataFrame) -> DataFrame:
    """strategy, entity, absolute_pass, risks: each limit must hold; a factor without a value fails it."""
    fail_if_any(ranked.join(F.broadcast(limits), "strategy", "left_anti").select("strategy").distinct(), "strategies without limits")
    asked = ranked.select("strategy", "entity").join(F.broadcast(limits), "strategy")
    met = asked.join(panel.select("entity", "factor", "status", "raw_value"), ["entity", "factor"], "left")
    inside = (F.col("low").isNull() | (F.col("raw_value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("raw_value") <= F.col("high")))
    ok = F.coalesce((F.col("status") == VALUE) & inside, F.lit(False))
    why = F.when(~ok, F.struct("pos", F.concat("factor", F.when(F.coalesce(F.col("status") == VALUE, F.lit(False)), F.lit(":limit")).otherwise(F.lit(":missing"))).alias("text")))
    return met.groupBy("strategy", "entity").agg(F.bool_and(ok).alias("absolute_pass"), F.transform(F.sort_array(F.collect_list(why)), lambda x: x["text"]).alias("risks"))


def qualify(results: DataFrame, panel: DataFrame, limits: DataFrame, least: float = LEAST_PERCENTILE) -> DataFrame:
    """strategy, entity, rank_percentile, percentile_pass, absolute_pass, qualified, risks of the eligible and ranked."""
    ranked = results.where("eligible and rank_percentile is not null").select("strategy", "entity", "rank_percentile")
    passed = F.col("rank_percentile") >= least
    return ranked.join(absolute(ranked, panel, limits), ["strategy", "entity"]).select("strategy", "entity", "rank_percentile", passed.alias("percentile_pass"), "absolute_pass", (passed & F.col("absolute_pass")).alias("qualified"), "risks")


def primary(qualified: DataFrame) -> DataFrame:
    """entity, strategy: the qualified strategy of the highest percentile; of equal ones the first by name."""
    return qualified.where("qualified").groupBy("entity").agg(F.min_by("strategy", F.struct((-F.col("rank_percentile")).alias("p"), "strategy")).alias("strategy"))
