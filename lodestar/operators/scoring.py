"""Cross-sectional scores: signed, weighted percentiles within the eligible population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import VALUE, tally, with_percentile
from lodestar.functions.tables import settle

#: Factors and signed weights of each strategy, in order.
STRATEGIES = {
    "value": (("pe_ttm", -1.0), ("pb", -1.0), ("ps_ttm", -1.0), ("pe_percentile", -1.0), ("pcf_operating_ttm", -1.0), ("roe_ttm", 1.0)),
    "growth": (("revenue_yoy", 1.0), ("revenue_cagr_3y", 1.0), ("net_profit_parent_yoy", 1.0), ("net_profit_parent_cagr_3y", 1.0)),
    "garp": (("peg", -1.0), ("pe_percentile", -1.0), ("revenue_cagr_3y", 1.0), ("net_profit_parent_cagr_3y", 1.0), ("roe_ttm", 1.0)),
    "quality": (("roe_ttm", 1.0), ("gross_margin", 1.0), ("debt_to_asset", -1.0), ("ocf_to_net_profit", 1.0)),
    "dividend": (("dividend_paid_ratio", 1.0), ("ocf_to_net_profit", 1.0)),
    "momentum": (("ret_20d", 1.0), ("ret_60d", 1.0), ("proximity_52w_high", 1.0)),
}


def spec(spark: SparkSession, strategies: dict = STRATEGIES) -> DataFrame:
    """strategy, factor, weight, pos; refuses weights that are all 0. As many rows as the strategies have factors."""
    for name, factors in strategies.items():
        if not any(w for _, w in factors) or len({f for f, _ in factors}) != len(factors):
            raise ValueError(f"{name}: weights must not all be 0, nor a factor stand twice")
    rows = [(s, f, float(w), n) for s, factors in strategies.items() for n, (f, w) in enumerate(factors)]
    return spark.createDataFrame(rows, "strategy string, factor string, weight double, pos int")


def eligibility(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """entity, strategy, eligible, reasons: every factor of the strategy has a value, or why not, in the strategy's order."""
    entities = panel.select("entity").distinct()
    # the strategies' factors are a table of fixed size
    listed = weights.agg(F.collect_list(F.struct("strategy", "factor", "weight", "pos")).alias("_all"))
    needed = entities.join(F.broadcast(listed)).select("entity", F.inline("_all"))
    joined = needed.join(panel.select("entity", "factor", "status", "raw_value"), ["entity", "factor"], "left")
    ok = F.coalesce(F.col("status") == VALUE, F.lit(False))
    why = F.when(~ok, F.struct("pos", F.concat(F.col("factor"), F.lit(": "), F.coalesce("status", F.lit("MISSING"))).alias("text")))
    return joined.groupBy("entity", "strategy").agg(F.bool_and(ok).alias("eligible"), F.transform(F.sort_array(F.collect_list(why)), lambda x: x["text"]).alias("reasons"))


def score(panel: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """keys, entity, eligible, blend, score, rank_percentile, n, contributions: all strategies in one job.

    Percentiles are taken within the eligible population of a strategy, of the
    value times the weight's sign.  The rank is absent where one entity is alone.
    """
    status = F.coalesce(F.col("status") == VALUE, F.lit(False))
    needed = weights.groupBy(*keys).agg(F.count("*").alias("_need"))
    joined = panel.join(F.broadcast(weights), "factor")
    counted = joined.groupBy(*keys, "entity").agg(F.count_if(status).alias("_have")).join(F.broadcast(needed), list(keys))
    eligible = counted.where("_have = _need").select(*keys, "entity")
    values = joined.where(status).join(eligible, [*keys, "entity"], "left_semi")
    oriented = settle(values.withColumn("v", F.col("raw_value") * F.signum("weight")), "oriented")
    ranked = with_percentile(oriented, [*keys, "factor"], "v", "percentile")
    share = F.abs("weight").cast("decimal(18,6)") * F.col("percentile").cast("decimal(18,12)")
    item = F.struct("pos", "factor", "percentile", "weight", (F.abs("weight") * F.col("percentile")).alias("weighted"), "raw_value")
    blended = ranked.groupBy(*keys, "entity").agg((F.sum(share).cast("double") / F.sum(F.abs("weight"))).alias("blend"), F.sort_array(F.collect_list(item)).alias("contributions"))
    blended = settle(blended, "blended")
    sizes = blended.groupBy(*keys).agg(F.count("*").alias("n"))
    placed = with_percentile(blended, list(keys), "blend", "rank_percentile").join(sizes, list(keys)).withColumn("rank_percentile", F.when(F.col("n") > 1, F.col("rank_percentile")))
    return placed.select(*keys, "entity", F.round("blend", 12).alias("blend"), F.round(F.col("blend") * 100, 9).alias("score"), "rank_percentile", "n", "contributions")


def results(panel: DataFrame, weights: DataFrame, members: DataFrame) -> DataFrame:
    """entity, strategy, eligible, score, rank_percentile for each member: those not eligible come without numbers."""
    inside = panel.join(members.select("entity"), "entity", "left_semi")
    scored = score(inside, weights).select("strategy", "entity", "score", "rank_percentile", "blend")
    return eligibility(inside, weights).join(scored, ["strategy", "entity"], "left")


def explain(scored: DataFrame) -> DataFrame:
    """strategy, entity, pos, line, raw_value, percentile: the contributions as text, in order, and the numbers behind them."""
    each = scored.select("strategy", "entity", F.posexplode("contributions").alias("pos", "c"))
    line = F.format_string("%s p=%.4f w=%.2f", "c.factor", "c.percentile", "c.weight")
    return each.select("strategy", "entity", "pos", line.alias("line"), "c.raw_value", "c.percentile")


def preview(results: DataFrame) -> DataFrame:
    """Best scores first, unscored rows last."""
    return results.orderBy(F.col("score").desc_nulls_last(), "strategy", "entity")


def overlap_by_weights(panel: DataFrame, sets: DataFrame, base: str, top: int) -> DataFrame:
    """weight_set, strategy, common: how many of the base set's first top entities stay among the first top. sets: spec rows with weight_set."""
    order = Window.partitionBy("weight_set", "strategy").orderBy(F.desc("blend"), "entity")
    best = score(panel, sets, ("weight_set", "strategy")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)
    held = best.where(F.col("weight_set") == base).select("strategy", "entity", F.lit(1).alias("_in"))
    return best.join(held, ["strategy", "entity"], "left").groupBy("weight_set", "strategy").agg(F.count("_in").alias("common"))


def availability(panel: DataFrame) -> DataFrame:
    """factor, status, n."""
    return panel.groupBy("factor", "status").agg(F.count("*").alias("n"))


def contrast(panel: DataFrame, results: DataFrame, share: float = 0.1, least: int = 5) -> DataFrame:
    """strategy, factor, top_mean, rest_mean: mean values of the best share of the ranked and of the rest."""
    ordered = results.where("rank_percentile is not null").select("strategy", F.struct((-F.col("rank_percentile")).alias("last"), "entity").alias("at"))
    placed = tally(ordered, ["strategy"], "at").where(F.col("n") >= least)
    sliced = placed.select("strategy", "at.entity", (F.col("before") < F.greatest(F.lit(1), F.floor(F.col("n") * share))).alias("top"))
    values = panel.where(F.col("status") == VALUE).select("entity", "factor", F.round("raw_value", 6).cast("decimal(24,6)").alias("v"))
    mean = lambda cond: F.round(F.sum(F.when(cond, F.col("v"))).cast("double") / F.count_if(cond), 6)
    return sliced.join(values, "entity").groupBy("strategy", "factor").agg(mean(F.col("top")).alias("top_mean"), mean(~F.col("top")).alias("rest_mean"))
