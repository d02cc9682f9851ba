"""Scores and decisions over intents, replays, and records of what was done."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the dimensions of each profile, of 100 in sum.
PROFILES = {
    "EVENT": {"catalyst_quality": 20.0, "expectation_gap": 20.0, "directness": 15.0, "sector_strength": 15.0, "relative_strength": 15.0, "price_confirmation": 10.0, "risk_plan": 5.0},
    "SWING": {"fundamental_support": 15.0, "sector_trend": 15.0, "stock_trend": 20.0, "key_level": 20.0, "volume_confirmation": 10.0, "relative_strength": 10.0, "risk_reward": 10.0},
    "POSITION": {"industry_trend": 20.0, "competitiveness": 20.0, "financial_quality": 15.0, "earnings_growth": 15.0, "valuation": 15.0, "long_term_trend": 5.0, "risk_resilience": 5.0, "execution": 5.0},
}
#: What a profile needs besides its dimensions, the profiles that heed a veto, and the limits.
NEEDS = {"EVENT": ("stock_1d", "sector_1d", "benchmark_1d", "confirmed"), "SWING": ("target",), "POSITION": ()}
ALL, SHORT, EVENT = ("EVENT", "SWING", "POSITION"), ("EVENT", "SWING"), ("EVENT",)
GO, MAYBE, FOMO = 80.0, 70.0, 8


#: Stands between names in _named, and in no name.
_MARK = "\x1f"


def _named(items: list[Column]) -> Column:
    """Those of items, texts, that are not null, in order: as generated code, which a filter by a lambda is not."""
    text = F.concat_ws(_MARK, *items)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _MARK))


def risk_columns(intents: DataFrame) -> DataFrame:
    """intents with position_value, max_loss, loss_share of net value, and violations."""
    checks = {"ENTRY": F.col("entry") <= 0, "QUANTITY": F.col("quantity") <= 0, "STOP": F.col("stop") >= F.col("entry")}
    bad = _named([F.when(test, F.lit(name)) for name, test in checks.items()])
    loss = (F.col("entry") - F.col("stop")) * F.col("quantity")
    return intents.withColumn("position_value", F.col("entry") * F.col("quantity")).withColumn("max_loss", loss).withColumn("loss_share", F.try_divide(loss, F.col("nav"))).withColumn("violations", bad)


def confident(ratio: Column, confidence: Column) -> Column:
    """A ratio weakened by little confidence: half of it at none."""
    return ratio * (0.5 + 0.5 * confidence)


def dimension_scores(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with score, of those dimensions that are known, and missing, the names of the others."""
    known = F.lit(0.0)
    for d, w in weights.items():
        known = known + F.when(F.col(d).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(d))) * w).otherwise(0.0)
    return rows.withColumn("score", known).withColumn("missing", _named([F.when(F.col(d).isNull(), F.lit(d)) for d in weights]))


def vetoes(checks: dict[str, tuple[str, Column]]) -> tuple[Column, Column]:
    """Names of the hard and of the conditional vetoes that hold."""
    names = lambda kind: _named([F.when(test, F.lit(name)) for name, (k, test) in checks.items() if k == kind])
    return names("HARD"), names("CONDITIONAL")


def veto_checks() -> dict[str, tuple[str, Column]]:
    """The nine vetoes over rows of profile, invalidation, nav, quantity, validation, signal, action, losing, new_confirmation, sector_1d, stock_1d, confirmed, fomo and priced_in.

    Each holds only for the profiles that heed it.  A missing number or flag never
    makes a veto, but for a confirmation, which must be there.  A fomo outside 0 to 10 raises.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    fomo = F.when(~F.col("fomo").between(0, 10), F.raise_error(F.lit("fomo must be within 0 and 10")).cast("int")).otherwise(F.col("fomo"))
    rules = {
        "NO_INVALIDATION": ("HARD", ALL, blank("invalidation")),
        "NO_RISK_BUDGET": ("HARD", ALL, (F.col("nav") <= 0) | (F.col("quantity") <= 0)),
        "UPSTREAM_MARKET_CONTRADICTED": ("HARD", ALL, F.col("validation") == "CONTRADICTED"),
        "UPSTREAM_BREAKDOWN": ("HARD", ALL, F.col("signal") == "BREAKDOWN"),
        "AVERAGING_DOWN_WITHOUT_SIGNAL": ("HARD", ALL, (F.col("action") == "ADD") & F.col("losing") & blank("new_confirmation")),
        "RELATIVE_WEAKNESS": ("CONDITIONAL", EVENT, (F.col("sector_1d") > 0) & (F.col("stock_1d") <= 0)),
        "NO_PRICE_CONFIRMATION": ("CONDITIONAL", SHORT, ~F.coalesce(F.col("confirmed"), F.lit(False))),
        "EXTREME_FOMO": ("CONDITIONAL", ALL, fomo >= FOMO),
        "EXPECTATION_ALREADY_PRICED": ("CONDITIONAL", EVENT, F.col("priced_in")),
    }
    return {code: (kind, F.col("profile").isin(*heeding) & test) for code, (kind, heeding, test) in rules.items()}


def decide(score: Column, hard: Column, conditional: Column, missing: Column) -> Column:
    """NO_TRADE on a hard veto; WAIT where something is missing or conditional, at any score; else by score."""
    return F.when(F.size(hard) > 0, "NO_TRADE").when((F.size(missing) > 0) | (F.size(conditional) > 0), "WAIT").when(score >= GO, "PASS").when(score >= MAYBE, "WAIT").otherwise("NO_TRADE")


def _total(dimensions: Column) -> Column:
    return F.round(F.aggregate(dimensions, F.lit(0.0), lambda s, x: s + x["weight"] * x["ratio"]), 6)


def _by_profile(make) -> Column:
    """make(name, weights) of the row's profile; another profile raises."""
    chain = None
    for name, weights in PROFILES.items():
        chain = (F if chain is None else chain).when(F.col("profile") == name, make(name, weights))
    return chain.otherwise(F.raise_error(F.concat(F.lit("no such profile: "), F.coalesce("profile", F.lit("null")))))


def _any(tests: list[Column]) -> Column:
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def evaluate(rows: DataFrame) -> DataFrame:
    """rows with dimensions (name, weight, ratio of those known), score, missing, hard, conditional, decision and triggers.

    rows: profile, a column for each dimension of any profile, the columns of NEEDS
    and those of veto_checks.  What is missing is named in order: dimensions, then needs.
    Score and decision are plain sums, counts and tests of columns; lists of names are
    made only where they are read, triggers only for rows that wait.
    """
    part = lambda d, w: F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight"), _unit(F.col(d)).alias("ratio")))
    needed = lambda name, weights: [*sorted(weights), *NEEDS[name]]
    points = lambda d, w: F.coalesce(F.lit(w) * _unit(F.col(d)), F.lit(0.0))
    checks = veto_checks()
    hard, conditional = vetoes(checks)
    is_hard, is_conditional = (_any([test for k, test in checks.values() if k == kind]) for kind in ("HARD", "CONDITIONAL"))
    lacking = lambda before: lambda name, weights: [F.when(F.col(c).isNull(), F.lit(before + c)) for c in needed(name, weights)]
    missing = _by_profile(lambda *of: _named(lacking("")(*of)))
    told = {
        "dimensions": _by_profile(lambda _, weights: F.array_compact(F.array(*[part(d, w) for d, w in weights.items()]))),
        "missing": missing, "hard": hard, "conditional": conditional,
        "score": _by_profile(lambda _, weights: F.round(reduce(add, [points(d, w) for d, w in weights.items()], F.lit(0.0)), 6)),
        "_lacks": _by_profile(lambda name, weights: _any([F.col(c).isNull() for c in needed(name, weights)])), "_hard": is_hard, "_soft": is_conditional,
    }
    held = rows.withColumns(told)
    by_score = F.when(F.col("score") >= GO, "PASS").when(F.col("score") >= MAYBE, "WAIT").otherwise("NO_TRADE")
    held = held.withColumn("decision", F.when(F.col("_hard"), "NO_TRADE").when(F.col("_lacks") | F.col("_soft"), "WAIT").otherwise(by_score))
    none = F.array().cast("array<string>")
    lifts = [F.when(test, F.lit("lift " + code)) for code, (k, test) in checks.items() if k == "CONDITIONAL"]
    steps = _by_profile(lambda *of: _named([*lacking("complete ")(*of), *lifts]))
    waits = F.when(F.col("_lacks") | F.col("_soft"), steps).otherwise(F.array(F.lit("market conditions change")))
    return held.withColumn("triggers", F.when(F.col("decision") == "WAIT", waits).otherwise(none)).drop("_lacks", "_hard", "_soft")


def replay(stored: DataFrame, profiles: dict[str, dict[str, float]]) -> DataFrame:
    """Stored evaluations decided again by other weights, from nothing but what they hold; a dimension without a new weight keeps its own.

    Below the limit for waiting it is NO_TRADE whatever is missing; what is missing,
    conditional or below the limit for passing makes it WAIT.
    """
    weights = F.create_map(*[x for p, ws in profiles.items() for x in (F.lit(p), F.create_map(*[y for d, w in ws.items() for y in (F.lit(d), F.lit(w))]))])
    again = stored.withColumn("_w", weights[F.col("profile")])
    again = again.withColumn("dimensions", F.transform("dimensions", lambda x: F.struct(x["dimension"].alias("dimension"), F.coalesce(F.try_element_at("_w", x["dimension"]), x["weight"]).alias("weight"), x["ratio"].alias("ratio")))).drop("_w")
    again = again.withColumn("score", _total(F.col("dimensions")))
    open_ = (F.size("conditional") > 0) | (F.size("missing") > 0) | (F.col("score") < GO)
    decision = F.when((F.size("hard") > 0) | (F.col("score") < MAYBE), "NO_TRADE").when(open_, "WAIT").otherwise("PASS")
    again = again.withColumn("decision", decision)
    return again.withColumn("triggers", F.when((F.col("decision") == "WAIT") & (F.size("triggers") == 0), F.array(F.lit("verify the stored evidence again"))).otherwise(F.col("triggers")))


def discipline(executions: DataFrame, reviews: DataFrame) -> DataFrame:
    """overridden, n, reviewed, wins, win_rate, mean_pnl."""
    joined = executions.join(reviews, "execution_id", "left")
    pnl = F.col("pnl").cast("decimal(24,4)")
    return joined.groupBy("overridden").agg(F.count("*").alias("n"), F.count("pnl").alias("reviewed"), F.count_if(F.col("pnl") > 0).alias("wins"), F.try_divide(F.count_if(F.col("pnl") > 0), F.count("pnl")).alias("win_rate"), F.try_divide(F.sum(pnl).cast("double"), F.count("pnl")).alias("mean_pnl"))


def context(intents: DataFrame, panel: DataFrame, qualified: DataFrame, chosen: DataFrame) -> DataFrame:
    """intents with published, ret_20d and best: what is stored of their entities; nothing stored gives null."""
    short = panel.where("factor = 'ret_20d' and status = 'VALUE'").select("entity", F.col("raw_value").alias("ret_20d"))
    best = qualified.groupBy("entity").agg(F.max("rank_percentile").alias("best"))
    held = chosen.select("entity", F.lit(True).alias("published"))
    joined = intents.join(short, "entity", "left").join(best, "entity", "left").join(held, "entity", "left")
    return joined.withColumn("published", F.coalesce("published", F.lit(False)))


def _unit(c: Column) -> Column:
    """c within 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def volume_confirmation(stored: Column, now: Column) -> Column:
    """How far volume confirms, 0 to 1: the stored ratio, without one that of the intraday overlay."""
    return _unit(F.coalesce(stored, now))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).when(c.isNotNull(), 0.0)


def _has_text(c: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, 1.0).otherwise(0.0)


def event_ratios(context: DataFrame) -> DataFrame:
    """entity and the rule-based dimensions of an event, 0 to 1, null where what they rest on is missing.

    context: entity, stock_1d, sector_1d, benchmark_1d (returns of the day), confirmed
    (the intent's own flag) and invalidation (its rule).  relative_strength is the
    stock's return as a share of its sector's where that is positive, else
    whether it exceeds the sector's.
    """
    stock, sector = F.col("stock_1d"), F.col("sector_1d")
    relative = F.when(stock.isNull() | sector.isNull(), None).when(sector > 0, _unit(F.try_divide(stock, sector))).otherwise(_flag(stock > sector))
    return context.select(
        "entity", _flag(sector > F.col("benchmark_1d")).alias("sector_strength"), relative.alias("relative_strength"),
        _flag(F.col("confirmed")).alias("price_confirmation"), _has_text(F.col("invalidation")).alias("risk_plan"),
    )


def _best(*strategies: str) -> Column:
    return F.max(F.when(F.col("strategy").isin(*strategies), F.col("rank_percentile")))


def swing_ratios(evidence: DataFrame, qualified: DataFrame, results: DataFrame, validated: DataFrame, plans: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """entity and the dimensions of a swing, 0 to 1, null where what they rest on is missing.

    plans: entity, entry, stop, target, confirmed.  Support is the best percentile of
    a qualification, without any that of a strategy.  A reward of r times
    the loss counts r / (1 + r).  overlays, entity and volume_ratio_now, stand in for a
    volume ratio that is not stored.
    """
    if overlays is None:
        evidence = evidence.withColumn("volume_ratio_now", F.lit(None).cast("double"))
    else:
        evidence = evidence.join(overlays.select("entity", "volume_ratio_now"), "entity", "left")
    best = qualified.groupBy("entity").agg(F.max("rank_percentile").alias("_q"))
    other = results.groupBy("entity").agg(F.max("rank_percentile").alias("_s"))
    v = F.col("validation")
    held = validated.select("entity", F.when(v == "CONFIRMED", 1.0).when(v == "NEUTRAL", 0.5).when(v == "CONTRADICTED", 0.0).alias("sector_trend"))
    above = lambda c: F.when(F.col(c) > 0, 0.5).when(F.col(c).isNotNull(), 0.0)
    reward, loss = F.col("target") - F.col("entry"), F.col("entry") - F.col("stop")
    planned = plans.select("entity", F.when((reward > 0) & (loss > 0), reward / (reward + loss)).alias("risk_reward"), _flag(F.col("confirmed")).alias("key_level"))
    rows = evidence.select("entity", (above("ret_20d") + above("ret_60d")).alias("stock_trend"), volume_confirmation(F.col("volume_ratio"), F.col("volume_ratio_now")).alias("volume_confirmation"), _flag(F.col("relative_strength") > 0).alias("relative_strength"))
    joined = rows.join(best, "entity", "left").join(other, "entity", "left").join(held, "entity", "left").join(planned, "entity", "left")
    return joined.withColumn("fundamental_support", F.coalesce("_q", "_s")).drop("_q", "_s")


def position_ratios(results: DataFrame, evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """entity and the rule-based dimensions of a position, 0 to 1: the best percentile of the strategies that speak for each, the long trend and the plan.

    plans: entity, invalidation.  An entity without any percentile or plan has nulls there.
    """
    known = results.where("rank_percentile is not null")
    best = known.groupBy("entity").agg(_best("quality").alias("financial_quality"), _best("growth", "garp").alias("earnings_growth"), _best("value", "garp").alias("valuation"))
    trend = evidence.select("entity", _flag(F.col("ret_60d") > 0).alias("long_term_trend"))
    return trend.join(best, "entity", "left").join(plans.select("entity", _has_text(F.col("invalidation")).alias("execution")), "entity", "left")


def integrity(executions: DataFrame) -> DataFrame:
    """id, rule: exactly one of plan and override; an override stays within its cap and is acknowledged."""
    override = F.col("override_id").isNotNull()
    checks = {"ONE_OF_PLAN_AND_OVERRIDE": F.col("plan_id").isNotNull() == override, "CAP": override & (F.col("amount") > F.col("cap")), "NOT_ACKNOWLEDGED": override & ~F.col("acknowledged")}
    return executions.select("id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))).alias("rule"))
