"""Trade context as of each intent's own time, and the references between evaluations, plans, overrides and executions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import fail_if_any

#: Factors of which a context holds the value.
HELD = ("ret_20d", "ret_60d", "volume_ratio", "relative_strength")
#: What an overlay may bring.
OVERLAY = ("stock_1d", "sector_1d", "benchmark_1d", "confirmed", "volume_ratio_now", "price")
PUBLISHED, NOT_SELECTED, NOT_PUBLISHED = "published", "not_selected", "not_published"


def context(intents: DataFrame, panel: DataFrame, results: DataFrame, candidates: DataFrame, overlays: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """intents with what was stored for their entity on their own day, and the newest overlay of the day of their own time, not later than it.

    intents: intent_id, entity, as_of (date), at (timestamp).  panel: as_of, entity, factor, status,
    raw_value.  results: as_of, entity, strategy, score, rank_percentile.  candidates: as_of, entity,
    validation, signal, lineage, at most one an entity and day.  overlays: entity, seen_at and OVERLAY.
    Further columns are not read.  published (kind, as_of) names the snapshots that are there,
    also those without rows; without it a day with rows counts.

    Adds HELD (a column each, of status VALUE), strategies (strategy, score, rank_percentile, in
    order), candidate_status, validation, signal, lineage, OVERLAY, seen_at and volume: the stored
    ratio, else the overlay's.  candidate_status is published; not_selected where the day has a
    candidate snapshot without the entity; else not_published.  An intent of a day without any
    snapshot raises.  Intents of all days are joined in one job; the days of snapshots are few.
    """
    if published is None:
        kinds = {"factor": panel, "strategy": results, "candidate": candidates}
        published = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "as_of").distinct() for k, df in kinds.items()])
    days = published.groupBy("as_of").agg(F.bool_or(F.col("kind") == "candidate").alias("_chosen"))
    fail_if_any(intents.select("as_of").distinct().join(days, "as_of", "left_anti"), "days without any snapshot")

    key = ["as_of", "entity"]
    asked = intents.select(*key).distinct()
    value = lambda f: F.max(F.when((F.col("factor") == f) & (F.col("status") == "VALUE"), F.col("raw_value"))).alias(f)
    held = panel.where(F.col("factor").isin(*HELD)).join(asked, key, "left_semi").groupBy(*key).agg(*[value(f) for f in HELD])
    scored = results.join(asked, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("strategy", "score", "rank_percentile"))).alias("strategies"))
    chosen = candidates.select(*key, "validation", "signal", "lineage", F.lit(True).alias("_there"))

    # overlays are of one day, so an intent meets those of its entity and day alone
    wanted = intents.select("intent_id", "entity", "at", F.to_date("at").alias("_day"))
    seen = wanted.join(overlays.select("entity", F.to_date("seen_at").alias("_day"), "seen_at", *OVERLAY), ["entity", "_day"]).where(F.col("seen_at") <= F.col("at"))
    newest = seen.groupBy("intent_id").agg(F.max_by(F.struct("seen_at", *OVERLAY), "seen_at").alias("_o"))

    kind = scored.schema["strategies"].dataType
    joined = intents.join(held, key, "left").join(scored, key, "left").join(chosen, key, "left").join(days, "as_of", "left").join(newest, "intent_id", "left")
    status = F.when(F.col("_there"), PUBLISHED).when(F.col("_chosen"), NOT_SELECTED).otherwise(NOT_PUBLISHED)
    added = {"strategies": F.coalesce("strategies", F.array().cast(kind)), "candidate_status": status, **{c: F.col(f"_o.{c}") for c in ("seen_at", *OVERLAY)}}
    out = joined.withColumns(added).withColumn("volume", F.coalesce("volume_ratio", "volume_ratio_now"))
    return out.drop("_there", "_chosen", "_o")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def override_findings(overrides: DataFrame, evaluations: DataFrame) -> DataFrame:
    """id, rule, refers_to: overrides against the evaluations that they name.

    EVALUATION: it is not stored.  CAP: below 0, or not below the evaluation's proposal.
    REASON, EVIDENCE, STOP: empty.  FOMO: outside 0 to 10.  NOT_ACKNOWLEDGED.  overrides: id,
    evaluation_id, reason, evidence (array), stop_rule, acknowledged, fomo, cap.
    evaluations: id, decision, proposed.
    """
    stored = evaluations.select(F.col("id").alias("evaluation_id"), "proposed", F.lit(True).alias("_there"))
    rows = overrides.join(stored, "evaluation_id", "left")
    there = F.coalesce("_there", F.lit(False))
    rules = {
        "EVALUATION": ~there, "CAP": there & ~F.coalesce((F.col("cap") >= 0) & (F.col("cap") < F.col("proposed")), F.lit(False)), "REASON": _blank(F.col("reason")),
        "EVIDENCE": F.coalesce(F.size("evidence"), F.lit(0)) < 1, "STOP": _blank(F.col("stop_rule")), "FOMO": ~F.coalesce(F.col("fomo").between(0, 10), F.lit(False)), "NOT_ACKNOWLEDGED": ~F.coalesce("acknowledged", F.lit(False)),
    }
    return _told(rows, rules, F.col("evaluation_id"))


def execution_findings(executions: DataFrame, evaluations: DataFrame, plans: DataFrame, overrides: DataFrame) -> DataFrame:
    """id, rule, refers_to: executions against the evaluation, and the plan or override, that they name.

    EVALUATION: it is not stored.  ONE_OF: both a plan and an override, or neither.  FILL: a price or
    quantity that is not above 0.  NOT_PASSED: a plan although the evaluation did not pass.
    PLAN, OVERRIDE: not stored, or of another evaluation.  executions: id, evaluation_id,
    plan_id, override_id, price, quantity; plans and overrides: id, evaluation_id.
    """
    stored = evaluations.select(F.col("id").alias("evaluation_id"), "decision", F.lit(True).alias("_there"))
    owner = lambda df, c: df.select(F.col("id").alias(f"{c}_id"), F.col("evaluation_id").alias(f"_{c}_of"))
    rows = executions.join(stored, "evaluation_id", "left").join(owner(plans, "plan"), "plan_id", "left").join(owner(overrides, "override"), "override_id", "left")
    plan, override = F.col("plan_id").isNotNull(), F.col("override_id").isNotNull()
    one = plan != override
    belongs = lambda c: F.coalesce(F.col(f"_{c}_of") == F.col("evaluation_id"), F.lit(False))
    rules = {
        "EVALUATION": F.col("_there").isNull(), "ONE_OF": ~one, "FILL": ~F.coalesce((F.col("price") > 0) & (F.col("quantity") > 0), F.lit(False)),
        "NOT_PASSED": one & plan & F.col("_there").isNotNull() & ~F.coalesce(F.col("decision") == "PASS", F.lit(False)), "PLAN": one & plan & ~belongs("plan"), "OVERRIDE": one & override & ~belongs("override"),
    }
    refers = {"PLAN": F.col("plan_id"), "OVERRIDE": F.col("override_id")}
    return _told(rows, rules, F.col("evaluation_id"), refers)


def _told(rows: DataFrame, rules: dict[str, Column], refers_to: Column, others: dict[str, Column] | None = None) -> DataFrame:
    items = [F.when(test, F.struct(F.lit(rule).alias("rule"), (others or {}).get(rule, refers_to).cast("string").alias("refers_to"))) for rule, test in rules.items()]
    return rows.select("id", F.explode(F.array_compact(F.array(*items))).alias("f")).select("id", "f.*")

