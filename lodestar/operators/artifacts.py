"""Replay of the rules of stored results from raw rows, by code that shares nothing with what made them.

Findings are rows check, entity, observed, one for each offence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate table at most; the least traded amount; regimes.
MOST, LEAST_AMOUNT = 50, 100_000_000.0
REGIMES = ("BULL", "RANGE_UP", "RANGE", "RANGE_DOWN", "BEAR", "EXTREME_VOLATILITY")
#: Words of which a risk names one where a trend weakens.
WARNINGS = ("TREND_WEAKEN", "走弱", "trend weakens")


def _finding(rows: DataFrame, check: str, observed: Column, entity: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), (F.col("entity") if entity is None else entity).alias("entity"), observed.cast("string").alias("observed"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def candidate_rules(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """Offences within candidate rows: entity, action, primary_strategy, validation, signal, risks, results and qualifications (lineage.cite_results).

    COUNT: more than most rows.  TWICE: an entity stands again.  CONTRADICTED, BREAKDOWN:
    vetoed states.  ACTION: other than WATCH where a trend weakens or no signal is.  RISK:
    a weakening trend without a warning.  NONE_QUALIFIED: no qualification holds.
    NO_RESULT: one without a cited result.  PRIMARY: missing, not qualified, or not the one of
    the highest percentile, of equal ones the first by name.
    """
    held = F.filter("qualifications", lambda q: F.coalesce(q["qualified"], F.lit(False)) & ~F.isnull(q["strategy"]) & (F.trim(q["strategy"]) != ""))
    rows = candidates.withColumn("held", F.coalesce(held, F.array().cast(candidates.schema["qualifications"].dataType)))
    best = F.sort_array(F.transform("held", lambda q: F.struct((-F.coalesce(q["rank_percentile"].cast("double"), F.lit(-1.0))).alias("p"), q["strategy"].alias("s"))))
    rows = rows.withColumns({"best": F.get(best, F.lit(0))["s"], "cites": F.coalesce(F.col("results.strategy"), F.array().cast("array<string>"))})
    without = rows.select("entity", F.explode(F.array_except("held.strategy", "cites")).alias("s"))
    warned = F.exists(F.coalesce("risks", F.array().cast("array<string>")), lambda r: reduce(lambda a, b: a | b, [F.contains(r, F.lit(w)) for w in WARNINGS]))
    total = candidates.agg(F.count("*").alias("n"))
    parts = [
        _finding(total.where(F.col("n") > most), "COUNT", F.col("n"), F.lit(None).cast(candidates.schema["entity"].dataType)),
        _finding(candidates.groupBy("entity").count().where("count > 1"), "TWICE", F.col("count")),
        _finding(rows.where("validation = 'CONTRADICTED'"), "CONTRADICTED", F.col("validation")),
        _finding(rows.where("signal = 'BREAKDOWN'"), "BREAKDOWN", F.col("signal")),
        _finding(rows.where(F.col("signal").isin("TREND_WEAKEN", "NO_SIGNAL") & ~F.col("action").eqNullSafe("WATCH")), "ACTION", F.concat_ws(" ", "signal", "action")),
        _finding(rows.where((F.col("signal") == "TREND_WEAKEN") & ~warned), "RISK", F.col("signal")),
        _finding(rows.where(F.size("held") == 0), "NONE_QUALIFIED", F.lit("")),
        _finding(without, "NO_RESULT", F.col("s")),
        _finding(rows.where(_blank("primary_strategy") | ((F.size("held") > 0) & ~F.col("primary_strategy").eqNullSafe(F.col("best")))), "PRIMARY", F.concat_ws(" ", F.coalesce("primary_strategy", F.lit("")), "best")),
    ]
    return _union(parts)


def traded(bars: DataFrame, as_of: str, days: int = 20) -> DataFrame:
    """entity, amount: the mean traded amount of the last days at as_of, null where one of them has none or there are fewer. From bars alone."""
    newest = Window.partitionBy("entity").orderBy(F.desc("trade_date"))
    last = bars.where(F.col("trade_date") <= F.lit(as_of).cast("date")).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= days)
    whole = F.count("amount") == days
    return last.groupBy("entity").agg(F.when(whole, F.sum(F.col("amount").cast("decimal(18,4)")).cast("double") / days).alias("amount"))


def liquidity_replay(candidates: DataFrame, bars: DataFrame, as_of: str, *, least: float = LEAST_AMOUNT, days: int = 20, factor: str = "avg_amount_20d", within: float = 1e-6) -> DataFrame:
    """LIQUIDITY: candidates whose mean amount, from raw bars, is under least.  AMOUNT: cited amounts that bars do not give, to a share of within."""
    real = candidates.select("entity").distinct().join(traded(bars, as_of, days), "entity", "left")
    cited = candidates.select("entity", F.explode("results").alias("r")).select("entity", F.inline("r.cited")).where((F.col("factor") == factor) & (F.col("status") == "VALUE"))
    compared = cited.select("entity", "raw_value").distinct().join(real, "entity", "left")
    far = F.col("amount").isNull() | (F.abs(F.col("raw_value") - F.col("amount")) > F.abs("amount") * within)
    cited_low = compared.where(F.col("raw_value") < least).select("entity", F.col("raw_value").alias("amount"))
    low = real.where(F.col("amount") < least).select("entity", "amount").unionByName(cited_low).groupBy("entity").agg(F.min("amount").alias("amount"))
    return _finding(low, "LIQUIDITY", F.round("amount", 2)).unionByName(_finding(compared.where(far), "AMOUNT", F.round("raw_value", 2)))


def record_rules(rows: DataFrame, *, ranges: dict[str, tuple[float, float]], required: list[str], vocabularies: dict[str, list[str]], moment: str, as_of: str) -> DataFrame:
    """Offences within rows with an entity: RANGE (outside; null is fine, NaN is not), REQUIRED (null or empty), UNKNOWN (a name outside its vocabulary; empty is fine), TIME (moment is null or after as_of, a time with its zone)."""
    wrong = lambda c, low, high: F.col(c).isNotNull() & (F.isnan(F.col(c).cast("double")) | (F.col(c) < low) | (F.col(c) > high))
    tests = [("RANGE", c, wrong(c, *limits)) for c, limits in ranges.items()] + [("REQUIRED", c, _blank(c)) for c in required]
    tests += [("UNKNOWN", c, ~_blank(c) & ~F.col(c).isin(*names)) for c, names in vocabularies.items()]
    tests.append(("TIME", moment, F.col(moment).isNull() | (F.col(moment).cast("timestamp") > F.lit(as_of).cast("timestamp"))))
    items = [F.when(t, F.struct(F.lit(check).alias("check"), F.concat_ws(" ", F.lit(c), F.col(c).cast("string")).alias("observed"))) for check, c, t in tests]
    return rows.select("entity", F.explode(F.array_compact(F.array(*items))).alias("f")).select("f.check", "entity", "f.observed")


def availability(rows: DataFrame, as_of: str) -> DataFrame:
    """AVAILABLE: references of rows(entity, refs) that name a period but no time at which they were known, or one after as_of. refs: metric, period, known_at (a time). A bare metric says that there is no evidence."""
    refs = rows.select("entity", F.explode("refs").alias("r"))
    late = F.col("r.known_at") > F.lit(as_of).cast("timestamp")
    bad = (F.col("r.known_at").isNull() & F.col("r.period").isNotNull()) | F.coalesce(late, F.lit(False))
    return _finding(refs.where(bad), "AVAILABLE", F.concat_ws(" ", "r.metric", F.col("r.period").cast("string"), F.col("r.known_at").cast("string")))


def cited_scores(candidates: DataFrame) -> DataFrame:
    """SCORE, PERCENTILE: cited results outside 0 to 100, or 0 to 1; null is fine, NaN is not."""
    cited = candidates.select("entity", F.explode("results").alias("r")).select("entity", "r.strategy", "r.score", "r.rank_percentile")
    out = lambda c, high: F.col(c).isNotNull() & (F.isnan(F.col(c)) | (F.col(c) < 0) | (F.col(c) > high))
    return _finding(cited.where(out("score", 100)), "SCORE", F.concat_ws(" ", "strategy", F.col("score").cast("string"))).unionByName(
        _finding(cited.where(out("rank_percentile", 1)), "PERCENTILE", F.concat_ws(" ", "strategy", F.col("rank_percentile").cast("string")))
    )


def regime_rules(rows: DataFrame) -> DataFrame:
    """ONE: another number of rows than one.  REGIME: a name that is not known. rows: regime."""
    entity = F.lit(None).cast("long")
    return _finding(rows.agg(F.count("*").alias("n")).where("n <> 1"), "ONE", F.col("n"), entity).unionByName(_finding(rows.where(~F.coalesce(F.col("regime").isin(*REGIMES), F.lit(False))), "REGIME", F.col("regime"), entity))
