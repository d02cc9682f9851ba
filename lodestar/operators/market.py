"""Market context: breadth, benchmark trend, regime, evidence, validation and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import fail_if_any, visible
from lodestar.operators.factors import trailing, values_wide

#: The limits of regime, validation and signals.
STRONG, WEAK = 0.55, 0.40
TREND_UP, NEAR_PEAK, OFF_PEAK = 0.064, 0.85, 0.80
EXCESS_LOW, STRENGTH_LOW, VOLUME_HIGH, VOLUME_LOW, BREAK = -0.05, -0.15, 1.05, 0.70, -0.15


def _mean(column: str, cond: Column) -> Column:
    """Mean of values of four decimals, exact in any order."""
    return F.sum(F.when(cond, F.col(column).cast("decimal(18,4)"))).cast("double") / F.count_if(cond & F.col(column).isNotNull())


def breadth(bars: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """breadth, entities: share of entities whose last close is above the mean of their last n, among those with n closes."""
    each = trailing(bars, as_of, n).groupBy("entity").agg(F.count("close").alias("k"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("last"), _mean("close", F.col("rn") <= n).alias("mean"))
    full = each.where(F.col("k") == n)
    return full.agg((F.count_if(F.col("last") > F.col("mean")) / F.count("*")).alias("breadth"), F.count("*").alias("entities"))


def benchmark_evidence(benchmark: DataFrame, as_of: str, n: int = 60, short: int = 20) -> DataFrame:
    """One row: ret (last over first of the last n closes), trend (mean of short over mean of n), ret_short over short + 1 closes; null below n positive closes."""
    seen = visible(benchmark.where("close > 0"), as_of, "trade_date").orderBy(F.desc("trade_date")).limit(max(n, short + 1)).select(F.struct("trade_date", F.round("close", 4).alias("close")).alias("b"))
    closes = F.transform(F.sort_array(F.collect_list("b"), asc=False), lambda b: b["close"])
    total = lambda k: F.aggregate(F.slice("c", 1, k), F.lit(0).cast("decimal(28,4)"), lambda s, x: (s + x.cast("decimal(18,4)")).cast("decimal(28,4)")).cast("double")
    enough = F.size("c") >= n
    return seen.agg(closes.alias("c")).select(
        F.when(enough, F.get("c", F.lit(0)) / F.get("c", F.lit(n - 1)) - 1).alias("ret"),
        F.when(enough, (total(short) / short) / (total(n) / n)).alias("trend"),
        F.when(enough, F.get("c", F.lit(0)) / F.get("c", F.lit(short)) - 1).alias("ret_short"),
    )


def regime(breadth: DataFrame, benchmark: DataFrame, volatile: bool = False) -> DataFrame:
    """breadth, trend, regime: one row; missing evidence raises."""
    joined = breadth.select("breadth").join(benchmark.select("trend"))
    known = F.when(F.col("breadth").isNull() | F.col("trend").isNull(), F.raise_error(F.lit("regime evidence is missing")).cast("string"))
    base = known.when(F.col("breadth") > STRONG, F.when(F.col("trend") > 1, "BULL").otherwise("RANGE_UP")).when(F.col("breadth") >= WEAK, "RANGE").otherwise(F.when(F.col("trend") < 1, "BEAR").otherwise("RANGE_DOWN"))
    lower = F.when(base == "BULL", "RANGE_UP").when(base == "RANGE_UP", "RANGE").otherwise(base)
    return joined.select("breadth", "trend", (lower if volatile else base).alias("regime"))


def volume_ratio(bars: DataFrame, as_of: str, short: int = 5, long: int = 20) -> DataFrame:
    """entity, volume_ratio: mean volume of the last short bars over that of the last long, bars with volume only; null below long bars."""
    each = trailing(bars.where("volume > 0"), as_of, long).groupBy("entity").agg(F.count("*").alias("k"), _mean("volume", F.col("rn") <= short).alias("a"), _mean("volume", F.col("rn") <= long).alias("b"))
    return each.select("entity", F.when(F.col("k") >= long, F.col("a") / F.col("b")).alias("volume_ratio"))


def membership(industry: DataFrame, as_of: str) -> DataFrame:
    """entity, industry_id: visible memberships; an entity in two groups raises."""
    seen = visible(industry, as_of, "as_of").select("entity", "industry_id").distinct()
    fail_if_any(seen.groupBy("entity").count().where("count > 1"), "entities in two groups")
    return seen


def industry_excess(panel: DataFrame, members: DataFrame, benchmark: DataFrame) -> DataFrame:
    """industry_id, members, excess: mean short return of the members with a value, over the benchmark's."""
    values = panel.where("factor = 'ret_20d' and status = 'VALUE'").select("entity", F.round("raw_value", 9).cast("decimal(24,9)").alias("v"))
    mean = members.join(values, "entity").groupBy("industry_id").agg(F.count("*").alias("members"), (F.sum("v").cast("double") / F.count("*")).alias("mean"))
    return mean.join(F.broadcast(benchmark.select("ret_short"))).select("industry_id", "members", F.round(F.col("mean") - F.col("ret_short"), 9).alias("excess"))


def evidence(panel: DataFrame, bars: DataFrame, industry: DataFrame, benchmark_bars: DataFrame, as_of: str) -> DataFrame:
    """entity, avg_amount_20d, ret_20d, ret_60d, proximity_52w_high, dividend_yield_ttm, volume_ratio, relative_strength, industry_excess."""
    bench = benchmark_evidence(benchmark_bars, as_of)
    members = membership(industry, as_of)
    wide = values_wide(panel, ["avg_amount_20d", "ret_20d", "ret_60d", "proximity_52w_high", "dividend_yield_ttm"])
    excess = members.join(industry_excess(panel, members, bench), "industry_id").select("entity", F.col("excess").alias("industry_excess"))
    # the benchmark is one row
    strength = wide.join(F.broadcast(bench.select("ret"))).withColumn("relative_strength", F.round(F.col("ret_60d") - F.col("ret"), 9)).drop("ret")
    return strength.join(volume_ratio(bars, as_of), "entity", "left").join(excess, "entity", "left")


def validate(rows: DataFrame, *, veto_below: float, plenty: float) -> DataFrame:
    """rows(entity, strategy and evidence) with positives, negatives, validation; missing evidence raises, naming entities."""
    momentum = F.col("strategy") == "momentum"
    needed = ["ret_20d", "avg_amount_20d", "industry_excess", "relative_strength", "volume_ratio"]
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in needed] + [F.when(momentum & F.col("proximity_52w_high").isNull(), F.lit("proximity_52w_high"))]
    fail_if_any(rows.withColumn("missing", F.array_compact(F.array(*missing))).where("size(missing) > 0").select("entity", "missing"), "evidence is missing")
    veto = F.col("avg_amount_20d") < veto_below
    up = F.when(momentum, (F.col("ret_20d") > TREND_UP) & (F.col("proximity_52w_high") > NEAR_PEAK)).otherwise(F.col("ret_20d") > 0)
    down = F.when(momentum, ~up & ((F.col("ret_20d") < 0) | (F.col("proximity_52w_high") < OFF_PEAK))).otherwise(F.col("ret_20d") < BREAK)
    one = lambda *cs: sum((c.cast("int") for c in cs), F.lit(0))
    good = one(F.col("avg_amount_20d") >= plenty, up, F.col("industry_excess") > 0, F.col("relative_strength") > 0, F.col("volume_ratio") > VOLUME_HIGH)
    bad = one(veto, down, F.col("industry_excess") < EXCESS_LOW, F.col("relative_strength") < STRENGTH_LOW, F.col("volume_ratio") < VOLUME_LOW)
    verdict = F.when(veto | (bad >= 2), "CONTRADICTED").when(up & (bad == 0), "CONFIRMED").otherwise("NEUTRAL")
    return rows.withColumn("positives", good).withColumn("negatives", bad).withColumn("validation", verdict)


def signal(strategy: Column) -> Column:
    """The state signal of a row of evidence; a missing number never meets a condition."""
    r20, r60, peak, paid = F.col("ret_20d"), F.col("ret_60d"), F.col("proximity_52w_high"), F.col("dividend_yield_ttm")
    momentum, calm = strategy == "momentum", strategy.isin("value", "dividend")
    return (
        F.when(r20 < BREAK, "BREAKDOWN")
        .when((r60 > 0.15) & (r20 < -0.05), "TREND_WEAKEN")
        .when(momentum & (peak >= 0.95), "BREAKOUT")
        .when(momentum & (r60 >= 0.20) & r20.between(0.0, 0.05), "PULLBACK")
        .when(momentum & (r20 >= TREND_UP) & (peak >= NEAR_PEAK) & (peak < 0.95), "TREND_CONTINUE")
        .when(calm & (paid >= 3.0) & (r20 > -0.05), "DIVIDEND_SUPPORT")
        .when(calm & r20.between(-0.05, 0.02), "VALUE_CONTRARIAN")
        .otherwise("NO_SIGNAL")
    )
