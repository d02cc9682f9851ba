"""Versions carried from factors to candidates, and the checks that every citation resolves.

A strategy's result cites the factors that it read, a candidate the results and
qualifications that it rests on; each citation has the version of what it cites.  The
versions of a row are the distinct union of those of its citations, in order.  Nothing
here looks at how results were computed: the checks read stored rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Versions of the rules, by strategy and by stage.
STRATEGY_VERSIONS = {"value": "value-2", "growth": "growth-1", "garp": "garp-1", "quality": "quality-1", "dividend": "dividend-1", "momentum": "momentum-3"}
POLICY_VERSIONS = {"qualification": "qualification-2", "market_validation": "validation-1", "signal": "signal-1", "regime": "regime-1", "candidate_policy": "policy-2", "universe": "universe-1"}
#: What a candidate's lineage must name.
DECLARED = ("factor", "strategy", "qualification", "candidate_policy", "regime", "market_validation", "signal")


def _listed(values: Column) -> Column:
    """Distinct values in order, as text with commas; null if there are none."""
    kept = F.sort_array(F.array_distinct(F.filter(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def _parts(listed: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def _by_strategy(versions: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])[F.col("strategy")]


def cite_factors(results: DataFrame, panel: DataFrame, weights: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """results with strategy_version, cited (the strategy's factors in order, as the panel has them: factor, factor_version, status, raw_value) and factor_versions.

    A factor that the panel lacks is not cited.  weights is a table of fixed size.
    """
    needed = results.select("strategy", "entity").join(F.broadcast(weights.select("strategy", "factor", "pos")), "strategy")
    found = needed.join(panel.select("entity", "factor", "factor_version", "status", "raw_value"), ["entity", "factor"])
    item = F.struct("pos", F.struct("factor", "factor_version", "status", "raw_value").alias("f"))
    cited = found.groupBy("strategy", "entity").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["f"]).alias("cited"))
    kind = cited.schema["cited"].dataType
    whole = results.join(cited, ["strategy", "entity"], "left").withColumn("cited", F.coalesce("cited", F.array().cast(kind)))
    return whole.withColumns({"strategy_version": _by_strategy(versions or STRATEGY_VERSIONS), "factor_versions": _listed(F.col("cited.factor_version"))})


def cite_results(candidates: DataFrame, qualified: DataFrame, cited: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """candidates with policy_version, results and qualifications (of the strategies that the entity is qualified for, by strategy) and lineage, the versions that both and the policies declare.

    cited are the rows of cite_factors; an entity has at most one result for each strategy.
    """
    policy = versions or POLICY_VERSIONS
    own = qualified.where("qualified").join(candidates.select("entity"), "entity", "left_semi")
    held = own.join(cited.select("strategy", "entity", "score", "strategy_version", "cited", "factor_versions"), ["strategy", "entity"], "left")
    result = F.struct("strategy", "strategy_version", "score", "rank_percentile", "cited", "factor_versions")
    passed = F.struct("strategy", F.lit(policy["qualification"]).alias("qualification_version"), "qualified", "rank_percentile")
    there = F.col("strategy_version").isNotNull()
    each = held.groupBy("entity").agg(F.sort_array(F.collect_list(F.when(there, result))).alias("results"), F.sort_array(F.collect_list(passed)).alias("qualifications"))
    told = {
        "factor": _listed(F.flatten(F.transform("results", lambda r: _parts(r["factor_versions"])))),
        "strategy": _listed(F.col("results.strategy_version")),
        "qualification": _listed(F.col("qualifications.qualification_version")),
        **{k: F.lit(policy[k]) for k in ("candidate_policy", "regime", "market_validation", "signal")},
    }
    lineage = F.struct(*[told[k].alias(k) for k in DECLARED])
    return candidates.join(each, "entity", "left").withColumns({"policy_version": F.lit(policy["candidate_policy"]), "lineage": lineage})


def _finding(rows: DataFrame, check: str, entity: str, observed: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col(entity).alias("entity"), observed.alias("observed"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _results(candidates: DataFrame) -> DataFrame:
    return candidates.select("entity", "lineage", F.explode("results").alias("r")).select("entity", "lineage", "r.*")


def orphans(candidates: DataFrame, results: DataFrame, panel: DataFrame) -> DataFrame:
    """check, entity, observed of citations that the day's stored rows do not hold.

    QUALIFIED: a strategy that the entity is qualified for, without a result of any
    version.  STRATEGY, FACTOR: a cited result or factor, of that version.
    """
    cited = _results(candidates)
    passed = candidates.select("entity", F.explode("qualifications").alias("q")).where("q.qualified").select("entity", "q.strategy")
    factors = cited.select("entity", F.inline("cited")).select("entity", "factor", "factor_version").distinct()
    stored = results.select("entity", "strategy", "strategy_version")
    parts = [
        _finding(passed.join(stored, ["entity", "strategy"], "left_anti"), "QUALIFIED", "entity", F.col("strategy")),
        _finding(cited.join(stored, ["entity", "strategy", "strategy_version"], "left_anti"), "STRATEGY", "entity", F.concat_ws(" ", "strategy", "strategy_version")),
        _finding(factors.join(panel.select("entity", "factor", "factor_version"), ["entity", "factor", "factor_version"], "left_anti"), "FACTOR", "entity", F.concat_ws(" ", "factor", "factor_version")),
    ]
    return _union(parts)


def undeclared(candidates: DataFrame) -> DataFrame:
    """check, entity, observed of versions that a candidate cites without declaring them, or should declare and does not.

    EMPTY: a kind of DECLARED, or the policy's version, that is empty.  STRATEGY: a result
    of a version that the lineage does not list.  QUALIFICATION: likewise, where a
    qualification has a version and the lineage lists any.
    """
    empty = F.array(*[F.when(F.size(_parts(F.col(f"lineage.{k}"))) == 0, F.lit(k)) for k in DECLARED], F.when(F.trim(F.coalesce("policy_version", F.lit(""))) == "", F.lit("policy_version")))
    results = _results(candidates)
    version = F.trim(F.coalesce("strategy_version", F.lit("")))
    passed = candidates.select("entity", "lineage", F.explode("qualifications").alias("q"))
    declared, held = _parts(F.col("lineage.qualification")), F.trim(F.coalesce("q.qualification_version", F.lit("")))
    parts = [
        _finding(candidates.select("entity", F.explode(F.array_compact(empty)).alias("k")), "EMPTY", "entity", F.col("k")),
        _finding(results.where(~F.array_contains(_parts(F.col("lineage.strategy")), version)), "STRATEGY", "entity", F.concat_ws(" ", "strategy", version)),
        _finding(passed.where((held != "") & (F.size(declared) > 0) & ~F.array_contains(declared, held)), "QUALIFICATION", "entity", F.concat_ws(" ", "q.strategy", held)),
    ]
    return _union(parts)


def versions_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """kind, versions, n: the distinct versions of each column over all rows, in order, and how many rows have none. A cell may list several. Versions are few; they are combined before the shuffle."""
    parts = [rows.agg(_listed(F.flatten(F.transform(F.collect_set(c), lambda v: _parts(v)))).alias("versions"), F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "").alias("n")).select(F.lit(c).alias("kind"), "versions", "n") for c in columns]
    return _union(parts)
