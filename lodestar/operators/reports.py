"""Calibration, coverage and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import VALUE, at_places, nearest_rank, visible
from lodestar.operators.market import signal

TOP = 0.90


def distribution(panel: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """factor, n_value, n_null, n_stale, n_error, a column for each fraction, least, most."""
    held = panel.where(F.col("status") == VALUE)
    counts = panel.groupBy("factor").agg(F.count_if(F.col("status") == VALUE).alias("n_value"), *[F.count_if(F.col("status") == s).alias(c) for s, c in (("NULL", "n_null"), ("STALE", "n_stale"), ("SOURCE_ERROR", "n_error"))], F.min("raw_value").alias("least"), F.max("raw_value").alias("most"))
    return counts.join(nearest_rank(held, ["factor"], "raw_value", fractions), "factor", "left")


def _ranked(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("strategy").orderBy(*order)))


def boundary_samples(results: DataFrame, n: int = 5, cut: float = TOP) -> DataFrame:
    """strategy, entity, segment: the best n, the last n at or above the cut, the first n below it; each entity in its first segment."""
    ranked = results.where("rank_percentile is not null")
    down, up = (F.desc("rank_percentile"), F.col("entity")), (F.col("rank_percentile"), F.col("entity"))
    parts = [(ranked, down, "a_top"), (ranked.where(F.col("rank_percentile") >= cut), up, "b_above"), (ranked.where(F.col("rank_percentile") < cut), down, "c_below")]
    picked = [_ranked(rows, *order).where(F.col("_k") <= n).select("strategy", "entity", F.lit(name).alias("segment")) for rows, order, name in parts]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).groupBy("strategy", "entity").agg(F.min("segment").alias("segment"))


def with_values(samples: DataFrame, panel: DataFrame, weights: DataFrame) -> DataFrame:
    """samples with a row for each factor of their strategy: factor, status, raw_value."""
    return samples.join(F.broadcast(weights.select("strategy", "factor")), "strategy").join(panel.select("entity", "factor", "status", "raw_value"), ["entity", "factor"], "left")


def score_quantiles(results: DataFrame) -> DataFrame:
    """strategy, least, p25, median, p75, most: the score at place floor(n * f)."""
    place = lambda f: F.least(F.col("n") - 1, F.floor(F.col("n") * f))
    return at_places(results, ["strategy"], "score", {n: place(f) for n, f in (("least", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("most", 1.0))})


def boundary_line(results: DataFrame, cut: float = TOP) -> DataFrame:
    """strategy, rank_percentile, score, entity of the last member at or above the cut."""
    last = F.min(F.struct("rank_percentile", "entity", "score"))
    return results.where(F.col("rank_percentile") >= cut).groupBy("strategy").agg(last.alias("l")).select("strategy", "l.*")


def industry_distribution(results: DataFrame, industry: DataFrame, cut: float = TOP) -> DataFrame:
    top = results.where(F.col("rank_percentile") >= cut).select("strategy", "entity")
    return top.join(industry.select("entity", "industry_name"), "entity", "left").groupBy("strategy", F.coalesce("industry_name", F.lit("UNKNOWN")).alias("industry_name")).agg(F.count("*").alias("n"))


def overlap(results: DataFrame, strategies: list[str], cut: float = TOP) -> DataFrame:
    """first, second, n: entities in the top of both, for every pair of strategies; pairs are made within an entity's few strategies."""
    sets = results.where(F.col("rank_percentile") >= cut).groupBy("entity").agg(F.sort_array(F.collect_set("strategy")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    counted = sets.select(F.inline(pairs)).groupBy("first", "second").agg(F.count("*").alias("n"))
    names = sorted(strategies)
    every = results.sparkSession.createDataFrame([(a, b) for a in names for b in names if a < b], "first string, second string")
    return every.join(counted, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n"))


def sensitivity(results: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    """strategy, cut, n."""
    ranked = results.where("rank_percentile is not null")
    items = F.array(*[F.struct(F.lit(c).alias("cut"), (F.col("rank_percentile") >= c).alias("above")) for c in cuts])
    return ranked.select("strategy", F.inline(items)).groupBy("strategy", "cut").agg(F.count_if("above").alias("n"))


def anomalies(panel: DataFrame, names: list[str]) -> DataFrame:
    held = panel.where((F.col("status") == VALUE) & F.col("factor").isin(*names))
    middle = {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.ceil((F.col("n") - 1) / 2)}
    halves = at_places(held, ["factor"], "raw_value", middle).select("factor", ((F.col("_low") + F.col("_high")) / 2).alias("median"))
    return held.groupBy("factor").agg(F.count("*").alias("n"), F.min("raw_value").alias("least"), F.max("raw_value").alias("most")).join(halves, "factor")


def mapping_coverage(members: DataFrame, mapping: DataFrame, full: bool = False) -> DataFrame:
    """total, missing, ratio; raises if full coverage is asked for and not there."""
    joined = members.join(mapping.select("entity", F.lit(1).alias("_m")).distinct(), "entity", "left")
    out = joined.agg(F.count("*").alias("total"), F.count_if(F.col("_m").isNull()).alias("missing")).withColumn("ratio", (F.col("total") - F.col("missing")) / F.col("total"))
    if full and out.first().missing:
        raise ValueError("entities without a group")
    return out


def population(listing: DataFrame, prefiltered: DataFrame, members: DataFrame) -> DataFrame:
    a, b, c = listing.agg(F.count("*").alias("listed")), prefiltered.agg(F.count_if(F.size("failed") == 0).alias("prefiltered")), members.agg(F.count("*").alias("researched"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).withColumn("ratio", F.try_divide("researched", "listed"))  # three single rows


def field_coverage(latest: DataFrame, members: DataFrame) -> DataFrame:
    """metric, n, ratio: members whose newest visible row of the metric has a value."""
    total = members.agg(F.count("*").alias("_t"))
    counted = latest.where("value is not null").join(members, "entity", "left_semi").groupBy("metric").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total)).select("metric", "n", (F.col("n") / F.col("_t")).alias("ratio"))


def factor_coverage(panel: DataFrame, members: DataFrame) -> DataFrame:
    return panel.join(members, "entity", "left_semi").groupBy("factor").agg(F.count_if(F.col("status") == VALUE).alias("n"), F.count("*").alias("total"))


def scoreable(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """strategy, scoreable, blocking: entities with all of the strategy's factors, and cells without a value."""
    each = panel.join(F.broadcast(weights), "factor").groupBy("strategy", "entity").agg(F.count_if(F.col("status") != VALUE).alias("b"))
    return each.groupBy("strategy").agg(F.count_if(F.col("b") == 0).alias("scoreable"), F.sum("b").alias("blocking"))


def dividend_coverage(dividends: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """One row over the members' events known at as_of: entities with any, with cash paid, with ex and record dates, events, plans, implemented, and members without any."""
    done = F.col("status") == "implemented"
    each = visible(dividends, as_of, "announce_date").groupBy("entity").agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "plan").alias("plans"), F.count_if(done).alias("implemented"),
        F.count_if(done & (F.col("cash_per_10") > 0)).alias("cash"), F.count("ex_date").alias("ex"), F.count("record_date").alias("record"),
    )
    some = lambda c, name: F.count_if(F.col(c) > 0).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    asked = members.select("entity").distinct().join(each, "entity", "left")
    return asked.agg(
        F.count("*").alias("members"), some("events", "with_any"), some("cash", "with_cash"), some("ex", "with_ex_date"), some("record", "with_record_date"),
        total("events"), total("plans"), total("implemented"), F.count_if(F.col("events").isNull()).alias("missing"),
    )


def without_dividends(dividends: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """entity of each member without an event known at as_of."""
    return members.select("entity").distinct().join(visible(dividends, as_of, "announce_date"), "entity", "left_anti")


def signal_readiness(qualified: DataFrame, panel: DataFrame, names: list[str], fractions: dict[str, float]) -> DataFrame:
    """strategy, factor, n, missing, a column for each fraction, least, most, lowest, highest over qualified entities; the last two are entities, the first of equal ones."""
    asked = qualified.where("qualified").select("strategy", "entity", F.explode(F.array(*[F.lit(n) for n in names])).alias("factor"))
    held = panel.where(F.col("status") == VALUE).select("entity", "factor", "raw_value")
    rows = asked.join(held, ["entity", "factor"], "left")
    v = F.col("raw_value")
    first = lambda key, name: F.min(F.when(v.isNotNull(), F.struct(key.alias("k"), "entity")))["entity"].alias(name)
    ends = rows.groupBy("strategy", "factor").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("least"), F.max(v).alias("most"), first(v, "lowest"), first(-v, "highest"))
    return ends.join(nearest_rank(rows, ["strategy", "factor"], "raw_value", fractions), ["strategy", "factor"], "left")


def impact(results: DataFrame, qualified: DataFrame) -> DataFrame:
    """strategy, eligible, ranked, top, absolute, both, for every strategy with results."""
    known = results.groupBy("strategy").agg(F.count_if("eligible").alias("eligible"), F.count("rank_percentile").alias("ranked"))
    passed = qualified.groupBy("strategy").agg(F.count_if("percentile_pass").alias("top"), F.count_if("absolute_pass").alias("absolute"), F.count_if("qualified").alias("both"))
    return known.join(passed, "strategy", "left").fillna(0, ["top", "absolute", "both"])


def failure_reasons(qualified: DataFrame) -> DataFrame:
    return qualified.select("strategy", F.explode("risks").alias("reason")).groupBy("strategy", "reason").agg(F.count("*").alias("n"))


def closest(qualified: DataFrame, panel: DataFrame, limits: DataFrame, n: int) -> DataFrame:
    """strategy, entity, absolute_pass, distance: the n passes and the n failures nearest to any limit, relative to it."""
    held = panel.where(F.col("status") == VALUE).select("entity", "factor", "raw_value")
    rows = qualified.select("strategy", "entity", "absolute_pass").join(F.broadcast(limits), "strategy").join(held, ["entity", "factor"])
    away = lambda c: F.abs(F.col("raw_value") - F.col(c)) / F.abs(c)
    near = rows.groupBy("strategy", "entity", "absolute_pass").agg(F.min(F.least(away("low"), away("high"))).alias("distance"))
    order = Window.partitionBy("strategy", "absolute_pass").orderBy("distance", "entity")
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def evidence_impact(qualified: DataFrame, evidence: DataFrame, mapped: DataFrame, benchmark: DataFrame) -> DataFrame:
    """strategy, qualified, complete, no_industry, no_benchmark, no_volume, and the counts of three signals, over qualified entities.

    mapped: entities with an industry.  benchmark: one row with ret.
    """
    known = benchmark.agg((F.count("ret") > 0).alias("_bench"))
    rows = qualified.where("qualified").select("strategy", "entity").join(evidence, "entity", "left")
    rows = rows.join(mapped.select("entity", F.lit(True).alias("_mapped")).distinct(), "entity", "left").join(F.broadcast(known))
    whole = F.col("ret_20d").isNotNull() & F.col("proximity_52w_high").isNotNull() & F.col("volume_ratio").isNotNull() & F.col("_mapped").isNotNull() & F.col("_bench")
    told = rows.withColumn("_signal", signal(F.col("strategy")))
    return told.groupBy("strategy").agg(
        F.count("*").alias("qualified"), F.count_if(whole).alias("complete"), F.count_if(F.col("_mapped").isNull()).alias("no_industry"), F.count_if(~F.col("_bench")).alias("no_benchmark"),
        F.count_if(F.col("volume_ratio").isNull()).alias("no_volume"), *[F.count_if(F.col("_signal") == s).alias(s.lower()) for s in ("BREAKDOWN", "TREND_WEAKEN", "NO_SIGNAL")],
    )
