"""Registered queries of the daily stages: factors, population, scores, gates, market, candidates, reads and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import columns
from lodestar.operators import candidates, discovery, factors, market, qualify, reports, scoring, universe
from lodestar.plans import testbed
from lodestar.plans.day import LIMITS, Day
from lodestar.plans.register import Register

register = Register()
QUERIES, ORACLES = register.queries, register.oracles
AS_OF = testbed.AS_OF


def r6(c: str | Column, name: str | None = None) -> Column:
    """A double to six places, as the oracles give it."""
    return F.round(c, 6).alias(name or c)


def joined(c: str) -> Column:
    """An array as text, null if it is empty."""
    return F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)


def _factor(*names: str):
    return ", ".join(f"'{n}'" for n in names)


def _panel(d: DataFrame, *names: str) -> DataFrame:
    return d.where(F.col("factor").isin(*names)).select("entity", "factor", "status", r6("raw_value"))


for _id, _names in (("e1_avg_amount", ("avg_amount_20d",)), ("e2_trailing_returns", ("ret_20d", "ret_60d")), ("e3_proximity_high", ("proximity_52w_high",))):
    register(_id, f"select entity, factor, status, round(raw_value, 6) as raw_value from price_panel where factor in ({_factor(*_names)})")(lambda d, n=_names: _panel(factors.price_factors(d.view("bars"), AS_OF), *n))


@register("e2_panel_returns", """select entity, trade_date, case when k = 21 and start <> 0 then round(close / start - 1, 6) end as ret from (select *, lag(close, 20) over w as start,
  count(close) over (partition by entity order by trade_date rows between 20 preceding and current row) as k from bars window w as (partition by entity order by trade_date))""")
def _(d: Day):
    return factors.panel_returns(d.view("bars")).select("entity", "trade_date", r6("ret"))


@register("e4_asof_latest", "select entity, metric, round(value, 6) as value, period, known from lo")
def _(d: Day):
    latest = factors.asof_latest(testbed.observations(d.spark, d.sf_dir), AS_OF)
    return latest.where("seen").select("entity", "metric", r6("value"), "period", "known")


@register("e5_status_precedence", "select entity, metric, status from ms")
def _(d: Day):
    rows = testbed.observations(d.spark, d.sf_dir)
    spine = factors.visible(d.view("bars"), AS_OF, "trade_date").select("entity").distinct()
    latest = factors.asof_latest(rows, AS_OF).withColumn("reported", F.lit(True))
    asked = spine.join(F.broadcast(rows.agg(F.collect_set("metric").alias("all")))).select("entity", F.explode("all").alias("metric"))
    status = factors.status_of(AS_OF, F.col("value"), F.col("known"), F.col("reported"), F.coalesce("seen", F.lit(False)), factors.STALE_DAYS)
    return asked.join(latest, ["entity", "metric"], "left").select("entity", "metric", status.alias("status"))


@register("e6_freshness", "select entity, metric, date_diff('day', known, date '2001-06-30') as age, date_diff('day', known, date '2001-06-30') > 120 as stale from lo where value is not null")
def _(d: Day):
    latest = factors.asof_latest(testbed.observations(d.spark, d.sf_dir), AS_OF).where("seen and value is not null")
    age = F.datediff(F.lit(AS_OF).cast("date"), "known").cast("long")
    return latest.select("entity", "metric", age.alias("age"), (age > 120).alias("stale"))


def _metrics(d: Day) -> DataFrame:
    spine = factors.visible(d.view("bars"), AS_OF, "trade_date").select("entity").distinct()
    return factors.metric_factors(testbed.observations(d.spark, d.sf_dir), spine, AS_OF)


@register("e7_ratio_factors", f"select entity, factor, status, round(raw_value, 6) as raw_value from metric_panel where factor in ({_factor(*[r[0] for r in factors.RATIOS])})")
def _(d: Day):
    return _panel(_metrics(d), *[r[0] for r in factors.RATIOS])


@register("e8_metric_factors", f"select entity, factor, status, round(raw_value, 6) as raw_value from metric_panel where factor in ({_factor(*factors.PASSED)})")
def _(d: Day):
    return _panel(_metrics(d), *factors.PASSED)


@register("e9_valuation_factors", "select entity, factor, status, round(raw_value, 6) as raw_value from valuation_panel")
def _(d: Day):
    spine = factors.visible(d.view("bars"), AS_OF, "trade_date").select("entity").distinct()
    return factors.valuation_factors(testbed.valuations(d.spark, d.sf_dir), spine, AS_OF).select("entity", "factor", "status", r6("raw_value"))


@register("e10_dividend_yield", "select entity, factor, status, round(case when status = 'VALUE' then raw_value end, 6) as raw_value from dy")
def _(d: Day):
    return factors.dividend_yield(d.view("dividends"), d.view("bars"), AS_OF).select("entity", "factor", "status", r6("raw_value"))


@register("e11_evidence_refs", "select entity, string_agg(metric || '@' || coalesce(cast(period as varchar), '-'), ',' order by metric) as refs from (select r.entity, r.metric, lo.period from (select distinct entity, metric from observations) r left join lo using (entity, metric)) group by entity")
def _(d: Day):
    refs = factors.evidence(testbed.observations(d.spark, d.sf_dir), AS_OF)
    text = F.transform("refs", lambda r: F.concat(r["metric"], F.lit("@"), F.coalesce(r["period"].cast("string"), F.lit("-"))))
    return refs.select("entity", F.array_join(text, ",").alias("refs"))


_described = ", ".join(f"('{f}', '{u}', '{','.join(factors.INPUTS[f])}')" for f, u in factors.UNITS.items())


@register("e12_factor_stage", f"select entity, factor, status, round(case when status = 'VALUE' then raw_value end, 6) as raw_value, unit, inputs, '{factors.VERSION}' as factor_version from panel join (values {_described}) t(factor, unit, inputs) using (factor)")
def _(d: Day):
    return d.panel.select("entity", "factor", "status", r6("raw_value"), "unit", F.array_join("inputs", ",").alias("inputs"), "factor_version")


@register("e13_panel_pivot", "select entity, round(avg_amount_20d, 6) as avg_amount_20d, round(ret_20d, 6) as ret_20d, round(ret_60d, 6) as ret_60d, round(dividend_yield_ttm, 6) as dividend_yield_ttm from wide")
def _(d: Day):
    names = ["avg_amount_20d", "ret_20d", "ret_60d", "dividend_yield_ttm"]
    return factors.values_wide(d.panel, names).select("entity", *[r6(n) for n in names])


# population

_listing = "select s.entity, array_to_string(list_filter([case when exchange not in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') then 'EXCHANGE' end, case when is_st then 'ST' end, case when is_delisting then 'DELISTING' end, case when date_diff('day', list_date, date '2001-06-30') < 365 then 'LISTING_AGE' end], lambda x: x is not null), ',') as failed from securities s"


@register("d1_rule_predicates", f"select entity, failed from ({_listing}) where failed <> ''")
def _(d: Day):
    failed = universe.prefilter(d.view("securities"), AS_OF, **LIMITS).where("size(failed) > 0")
    return failed.select("entity", F.array_join("failed", ",").alias("failed"))


@register("d2_market_data_presence", "select distinct entity from bars where trade_date = (select max(trade_date) from tb)")
def _(d: Day):
    return universe.traded(d.view("bars"), AS_OF)


@register("d3_liquidity_rule", "select entity, case when status = 'VALUE' and raw_value < 50000 then 'LOW_LIQUIDITY' when status <> 'VALUE' then 'NO_LIQUIDITY_MEASURE' else 'OK' end as verdict from price_panel where factor = 'avg_amount_20d'")
def _(d: Day):
    rows = d.price_panel.where("factor = 'avg_amount_20d'")
    verdict = F.when((F.col("status") == "VALUE") & (F.col("raw_value") < 50_000), "LOW_LIQUIDITY").when(F.col("status") != "VALUE", "NO_LIQUIDITY_MEASURE").otherwise("OK")
    return rows.select("entity", verdict.alias("verdict"))


@register("d4_duplicate_entity", "select entity, name, row_number() over (partition by entity order by position) > 1 as duplicate from (select entity, name, entity % 4 as position from securities union all select entity, name || ' B', 2 from securities where entity % 4 <> 2)")
def _(d: Day):
    s = d.view("securities").selectExpr("entity", "name", "list_date", "entity % 4 as position")
    twice = s.unionByName(s.where("entity % 4 <> 2").withColumn("name", F.concat("name", F.lit(" B"))).withColumn("position", F.lit(2)))
    return universe.first_profiles(twice).select("entity", "name", "duplicate")


@register("d5_all_failures", "select entity, array_to_string(failed, ',') as failed, len(failed) = 0 as included from uni")
def _(d: Day):
    return d.universe.select("entity", F.array_join("failed", ",").alias("failed"), "included")


@register("d8_listing_prefilter", f"select entity, failed, failed = '' as included from ({_listing})")
def _(d: Day):
    return universe.prefilter(d.view("securities"), AS_OF, **LIMITS).select("entity", F.array_join("failed", ",").alias("failed"), (F.size("failed") == 0).alias("included"))


@register("d9_research_population", f"select u.entity, l.failed = '' as listed, len(u.failed) = 0 as researched from uni u join ({_listing}) l using (entity)")
def _(d: Day):
    researched = d.universe
    listed = universe.prefilter(d.view("securities"), AS_OF, **LIMITS).select("entity", (F.size("failed") == 0).alias("listed"))
    return listed.join(researched.select("entity", F.col("included").alias("researched")), "entity")


@register("d10_stride_sample", "select entity, rn from (select entity, row_number() over (order by entity) - 1 as rn from (select distinct entity from securities)) where rn % 3 = 0 and rn < 30")
def _(d: Day):
    return universe.stride(d.view("securities"), 3, 10)


# scores

@register("f1_percentile_rank", "select factor, entity, round((rank() over (partition by factor order by raw_value) + (count(*) over (partition by factor, raw_value) - 1) / 2) / count(*) over (partition by factor), 6) as percentile from (select factor, entity, floor(raw_value * 4) as raw_value from panel where status = 'VALUE')")
def _(d: Day):
    rows = d.panel.where("status = 'VALUE'").select("factor", "entity", F.floor(F.col("raw_value") * 4).alias("v"))
    return columns.with_percentile(rows, ["factor"], "v", "percentile").select("factor", "entity", r6("percentile"))


@register("f2_eligibility", "select entity, strategy, eligible, reasons from el")
def _(d: Day):
    e = scoring.eligibility(d.panel.join(d.members, "entity", "left_semi"), d.weights)
    return e.select("entity", "strategy", "eligible", joined("reasons"))


@register("f3_weighted_score", "select strategy, entity, round(blend, 6) as blend, round(score, 6) as score from sc")
def _(d: Day):
    return d.scored.select("strategy", "entity", r6("blend"), r6("score"))


@register("f4_rank_percentile", "select strategy, entity, round(rank_percentile, 6) as rank_percentile, n from sc")
def _(d: Day):
    return d.scored.select("strategy", "entity", r6("rank_percentile"), "n")


@register("f5_contributions", "select strategy, entity, pos, factor, round(pct, 6) as percentile, round(abs(weight) * pct, 6) as weighted from sv")
def _(d: Day):
    c = d.scored.select("strategy", "entity", F.explode("contributions").alias("c")).select("strategy", "entity", "c.*")
    return c.select("strategy", "entity", "pos", "factor", r6("percentile"), r6("weighted"))


@register("f6_six_scanners", "select strategy, count(*) filter (eligible) as eligible, count(*) as total, round(max(score), 6) as best from res group by strategy")
def _(d: Day):
    return d.results.groupBy("strategy").agg(F.count_if("eligible").alias("eligible"), F.count("*").alias("total"), r6(F.max("score"), "best"))


@register("f7_momentum_variant", "select entity, round(score, 6) as score, round(rank_percentile, 6) as rank_percentile from sc where strategy = 'momentum'")
def _(d: Day):
    spec = scoring.spec(d.spark, {"momentum": scoring.STRATEGIES["momentum"]})
    return scoring.score(d.panel.join(d.members, "entity", "left_semi"), spec).select("entity", r6("score"), r6("rank_percentile"))


@register("f8_eligibility_only", "select entity, eligible from el where strategy = 'value'")
def _(d: Day):
    return scoring.eligibility(d.panel.join(d.members, "entity", "left_semi"), d.weights.where("strategy = 'value'")).select("entity", "eligible")


@register("f10_strategy_stage", "select strategy, entity, eligible, reasons, round(score, 6) as score, round(rank_percentile, 6) as rank_percentile from res")
def _(d: Day):
    return d.results.select("strategy", "entity", "eligible", joined("reasons"), r6("score"), r6("rank_percentile"))


@register("f11_explain", "select strategy, entity, sv.pos, factor || ' w=' || printf('%.2f', weight) as line, round(pct, 6) as percentile, round(p.raw_value, 6) as raw_value from sv join inside p using (entity, factor)")
def _(d: Day):
    lines = scoring.explain(d.scored)
    # the last digit of a percentile in the text may be rounded otherwise, so the number itself is compared
    return lines.select("strategy", "entity", "pos", F.regexp_replace("line", r" p=[0-9.]+", "").alias("line"), r6("percentile"), r6("raw_value"))


@register("f12_preview", "select strategy, entity, round(score, 6) as score from res order by score desc nulls last, strategy, entity limit 50")
def _(d: Day):
    return scoring.preview(d.results).limit(50).select("strategy", "entity", r6("score"))


@register("f13_weight_sensitivity", """select weight_set, strategy, count(*) filter (inbase) as common from (select t.*, b.entity is not null as inbase from (select * from (select *, row_number() over (partition by weight_set, strategy order by blend desc, entity) as rn from (
  select 'base' as weight_set, strategy, entity, round(cast(sum(cast(abs(weight) as decimal(18,6)) * cast(pct as decimal(18,12))) as double) / sum(abs(weight)), 12) as blend from sv group by strategy, entity union all
  select 'first_double', strategy, entity, round(cast(sum(cast(case when pos = 0 then 2 else 1 end * abs(weight) as decimal(18,6)) * cast(pct as decimal(18,12))) as double) / sum(case when pos = 0 then 2 else 1 end * abs(weight)), 12) from sv group by strategy, entity)) where rn <= 10) t
  left join (select strategy, entity from (select strategy, entity, row_number() over (partition by strategy order by blend desc, entity) as rn from sc) where rn <= 10) b using (strategy, entity)) group by weight_set, strategy""")
def _(d: Day):
    sets = d.weights.withColumn("weight_set", F.lit("base")).unionByName(d.weights.withColumn("weight_set", F.lit("first_double")).withColumn("weight", F.when(F.col("pos") == 0, F.col("weight") * 2).otherwise(F.col("weight"))))
    return scoring.overlap_by_weights(d.panel.join(d.members, "entity", "left_semi"), sets, "base", 10)


@register("f14_evidence_availability", "select factor, status, count(*) as n from panel group by factor, status")
def _(d: Day):
    return scoring.availability(d.panel)


@register("f15_phenotype_contrast", """select strategy, factor, round(cast(sum(v) filter (top) as double) / count(*) filter (top), 6) as top_mean, round(cast(sum(v) filter (not top) as double) / count(*) filter (not top), 6) as rest_mean
  from (select r.strategy, r.entity, rn <= greatest(1, floor(n * 0.1)) as top from (select strategy, entity, row_number() over (partition by strategy order by rank_percentile desc, entity) as rn, count(*) over (partition by strategy) as n from res where rank_percentile is not null) r where n >= 5)
  join (select entity, factor, cast(round(raw_value, 6) as decimal(24,6)) as v from panel where status = 'VALUE') using (entity) group by strategy, factor""")
def _(d: Day):
    return scoring.contrast(d.panel, d.results)


# gates

@register("g1_percentile_gate", "select strategy, entity, round(rank_percentile, 6) as rank_percentile from res where rank_percentile >= 0.9")
def _(d: Day):
    return d.results.where("rank_percentile >= 0.9").select("strategy", "entity", r6("rank_percentile"))


@register("g2_absolute_thresholds", "select strategy, entity, absolute_pass, risks from ab")
def _(d: Day):
    ranked = d.results.where("rank_percentile is not null")
    return qualify.absolute(ranked, d.panel, d.limits).select("strategy", "entity", "absolute_pass", joined("risks"))


@register("g3_dual_gate", "select strategy, entity, percentile_pass, absolute_pass, qualified from qual")
def _(d: Day):
    return d.qualified.select("strategy", "entity", "percentile_pass", "absolute_pass", "qualified")


@register("g4_qualification_stage", "select strategy, count(*) as ranked, count(*) filter (qualified) as qualified from qual group by strategy")
def _(d: Day):
    return d.qualified.groupBy("strategy").agg(F.count("*").alias("ranked"), F.count_if("qualified").alias("qualified"))


@register("g6_primary_strategy", "select entity, strategy from prim")
def _(d: Day):
    return qualify.primary(d.qualified)


# market

@register("h1_breadth", "select round(breadth, 6) as breadth, entities from br")
def _(d: Day):
    return market.breadth(d.view("bars"), AS_OF).select(r6("breadth"), "entities")


@register("h2_benchmark_evidence", "select round(ret, 6) as ret, round(trend, 6) as trend, round(ret_short, 6) as ret_short from be")
def _(d: Day):
    return market.benchmark_evidence(d.view("benchmark_bars"), AS_OF).select(r6("ret"), r6("trend"), r6("ret_short"))


@register("h3_regime", "select case when breadth > 0.55 then case when trend > 1 then 'BULL' else 'RANGE_UP' end when breadth >= 0.4 then 'RANGE' when trend < 1 then 'BEAR' else 'RANGE_DOWN' end as regime from br, be")
def _(d: Day):
    return d.regime.select("regime")


@register("h4_volume_ratio", "select entity, round(volume_ratio, 6) as volume_ratio from vr")
def _(d: Day):
    return market.volume_ratio(d.view("bars"), AS_OF).select("entity", r6("volume_ratio"))


@register("h5_relative_strength", "select entity, round(relative_strength, 6) as relative_strength from ev")
def _(d: Day):
    return d.evidence.select("entity", r6("relative_strength"))


_measures = ("avg_amount_20d", "ret_20d", "ret_60d", "proximity_52w_high", "volume_ratio", "relative_strength", "industry_excess")


@register("h6_stock_evidence", "select entity, " + ", ".join(f"round({m}, 6) as {m}" for m in _measures) + " from ev")
def _(d: Day):
    return d.evidence.select("entity", *[r6(m) for m in _measures])


@register("h7_membership_map", "select entity, industry_id from industry")
def _(d: Day):
    return market.membership(d.view("industry"), AS_OF)


@register("h8_supplement_union", "select entity, industry_id, count(*) as n from (select entity, industry_id from industry where entity % 5 <> 0 union all select entity, industry_id from industry where entity % 5 = 0) group by entity, industry_id")
def _(d: Day):
    own = d.view("industry")
    both = own.where("entity % 5 <> 0").unionByName(own.where("entity % 5 = 0"))
    return market.membership(both, AS_OF).groupBy("entity", "industry_id").agg(F.count("*").alias("n"))


@register("h9_industry_excess", "select industry_id, members, round(excess, 6) as excess from ix")
def _(d: Day):
    members = market.membership(d.view("industry"), AS_OF)
    return market.industry_excess(d.price_panel, members, market.benchmark_evidence(d.view("benchmark_bars"), AS_OF)).select("industry_id", "members", r6("excess"))


@register("h10_five_dimension_validation", "select entity, strategy, cast(good as int) as positives, cast(bad as int) as negatives, validation from va")
def _(d: Day):
    return d.validated.select("entity", "strategy", "positives", "negatives", "validation")


@register("h11_validation_stage", "select validation, count(*) as n from va group by validation")
def _(d: Day):
    return d.validated.groupBy("validation").agg(F.count("*").alias("n"))


@register("i1_signal_detection", """select entity, strategy, case when ret_20d < -0.15 then 'BREAKDOWN' when ret_60d > 0.15 and ret_20d < -0.05 then 'TREND_WEAKEN'
  when strategy = 'momentum' and proximity_52w_high >= 0.95 then 'BREAKOUT' when strategy = 'momentum' and ret_60d >= 0.2 and ret_20d between 0 and 0.05 then 'PULLBACK'
  when strategy = 'momentum' and ret_20d >= 0.064 and proximity_52w_high >= 0.85 and proximity_52w_high < 0.95 then 'TREND_CONTINUE'
  when strategy in ('value', 'dividend') and dividend_yield_ttm >= 3 and ret_20d > -0.05 then 'DIVIDEND_SUPPORT'
  when strategy in ('value', 'dividend') and ret_20d between -0.05 and 0.02 then 'VALUE_CONTRARIAN' else 'NO_SIGNAL' end as signal
  from wide cross join (select distinct strategy from weights)""")
def _(d: Day):
    wide = factors.values_wide(d.panel, ["ret_20d", "ret_60d", "proximity_52w_high", "dividend_yield_ttm"])
    rows = wide.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in scoring.STRATEGIES])))
    return rows.select("entity", "strategy", market.signal(F.col("strategy")).alias("signal"))


@register("i2_signal_stage", "select entity, strategy, signal from sg")
def _(d: Day):
    return d.validated.select("entity", "strategy", "signal")


# candidates

@register("j1_evidence_assembly", "select entity, round(best, 6) as best, n_qualified, strategies, primary_strategy, validation, signal from ca")
def _(d: Day):
    return d.assembled.select("entity", r6("best"), "n_qualified", F.array_join("strategies", ",").alias("strategies"), "primary_strategy", "validation", "signal")


@register("j2_vetoes", "select entity from live")
def _(d: Day):
    return candidates.without_vetoed(d.assembled).select("entity")


@register("j3_soft_reserve", "select entity from rv")
def _(d: Day):
    return candidates.reserve(candidates.without_vetoed(d.assembled), d.qualified, 2)


@register("j4_priority_fill", "select entity, held as is_reserve from pick")
def _(d: Day):
    return d.candidates.select("entity", "is_reserve")


@register("j5_final_order", "select position, entity, 'qualified for ' || replace(strategies, ',', ';qualified for ') as reasons from chosen")
def _(d: Day):
    return d.candidates.select(F.col("position").cast("long"), "entity", F.array_join("reasons", ";").alias("reasons"))


@register("j6_candidate_build", "select entity, primary_strategy, validation, signal, 'WATCH' as action, case when signal = 'TREND_WEAKEN' then 'trend weakens' end as risks from chosen")
def _(d: Day):
    return d.candidates.select("entity", "primary_strategy", "validation", "signal", "action", joined("risks"))


@register("j7_action_routing", "select ca.entity, case when chosen.entity is null then 'IGNORE' else 'WATCH' end as action from ca left join chosen using (entity)")
def _(d: Day):
    return candidates.route(d.assembled, d.candidates)


# reads

@register("k1_screen", "select row_number() over (order by rank_percentile desc nulls last, score desc nulls last, entity) as rank, entity, round(score, 6) as score, round(rank_percentile, 6) as rank_percentile from res where strategy = 'momentum' and eligible order by 1 limit 20")
def _(d: Day):
    spec = scoring.spec(d.spark, {"momentum": scoring.STRATEGIES["momentum"]})
    results = scoring.results(d.price_panel, spec, d.members)
    return discovery.screen(results, "momentum", limit=20).select(F.col("rank").cast("long").alias("rank"), "entity", r6("score"), r6("rank_percentile"))


@register("k2_strategy_coverage", "select strategy, count(*) as total, count(*) filter (eligible) as eligible, count(score) as scored, count(rank_percentile) as ranked from res group by strategy")
def _(d: Day):
    return discovery.coverage(d.results)


@register("k3_qualified_screen", "select entity, round(rank_percentile, 6) as rank_percentile from qual where strategy = 'quality' and qualified order by rank_percentile desc, entity limit 20")
def _(d: Day):
    return discovery.qualified_screen(d.qualified, "quality", 20).select("entity", r6("rank_percentile"))


_impact = "select r.strategy, r.eligible, r.ranked, coalesce(q.top, 0) as top, coalesce(q.absolute, 0) as absolute, coalesce(q.both, 0) as both from (select strategy, count(*) filter (eligible) as eligible, count(rank_percentile) as ranked from res group by strategy) r left join (select strategy, count(*) filter (percentile_pass) as top, count(*) filter (absolute_pass) as absolute, count(*) filter (qualified) as both from qual group by strategy) q using (strategy)"


@register("k3_qualified_coverage", f"select *, case when \"both\" = 0 then strategy || ': none qualified of ' || eligible || ' eligible and ' || ranked || ' ranked; check coverage and quality' end as warning from ({_impact})")
def _(d: Day):
    return discovery.qualified_coverage(d.results, d.qualified)


@register("k4_candidate_screen", "select position, entity, primary_strategy, strategies, round(best, 4) as best from chosen order by position limit 10")
def _(d: Day):
    return discovery.candidate_screen(d.candidates, 10).select(F.col("position").cast("long"), "entity", "primary_strategy", "strategies", "best")


@register("k5_today_overview", "select 'primary' as kind, primary_strategy as key, count(*) as n from chosen group by 2 union all select 'validation', validation, count(*) from chosen group by 2 union all select 'signal', signal, count(*) from chosen group by 2 union all select 'total', 'candidates', count(*) from chosen union all select 'top', cast(entity as varchar), position from chosen where position <= 5 union all select 'regime', case when breadth > 0.55 then case when trend > 1 then 'BULL' else 'RANGE_UP' end when breadth >= 0.4 then 'RANGE' when trend < 1 then 'BEAR' else 'RANGE_DOWN' end, 1 from br, be")
def _(d: Day):
    return discovery.overview(d.candidates, d.regime, 5)


@register("k6_entity_profile", "select u.entity, len(u.failed) = 0 as included, (select count(*) from panel p where p.entity = u.entity and status = 'VALUE') as n_values, (select string_agg(factor || ':' || status, ',' order by factor) from panel p where p.entity = u.entity) as factors, (select string_agg(strategy, ',' order by strategy) from res r where r.entity = u.entity and rank_percentile is not null) as ranked_in, t.state as tracking, (select string_agg(strategy, ',' order by strategy) from qual q where q.entity = u.entity and qualified) as qualified_for, case when c.entity is not null then 'published' else 'not_selected' end as status from uni u left join chosen c using (entity) left join (select user_id as entity, arg_max(event_type, event_id) as state from events group by user_id) t using (entity)")
def _(d: Day):
    tracked = d.view("events").groupBy(F.col("user_id").alias("entity")).agg(F.max_by("event_type", "event_id").alias("state"))
    p = discovery.profiles(d.universe, d.panel, d.results, d.qualified, d.candidates, tracked)
    p = p.withColumn("factors", F.transform("factors", lambda f: F.concat(f["factor"], F.lit(":"), f["status"])))
    return p.select("entity", "included", "n_values", joined("factors"), joined("ranked_in"), joined("qualified_for"), "status", "tracking")


@register("k7_factor_lookup", "select factor, status, round(case when status = 'VALUE' then raw_value end, 6) as raw_value from panel where entity = 7")
def _(d: Day):
    return d.panel.where("entity = 7").select("factor", "status", r6("raw_value"))


@register("k7_universe_lookup", "select entity, case when failed <> [] then array_to_string(failed, ',') end as failed, len(failed) = 0 as included from uni where entity = 7")
def _(d: Day):
    return d.universe.where("entity = 7").select("entity", joined("failed"), "included")


@register("k7_snapshot_dates", "select distinct trade_date as day, trade_date = (select max(trade_date) from bars) as latest from bars")
def _(d: Day):
    return discovery.dates(d.view("bars"), "trade_date")


@register("k8_low_coverage", "select strategy, scored / total < 0.7 as low from (select strategy, count(score) as scored, count(*) as total from res group by strategy)")
def _(d: Day):
    return discovery.low_coverage(discovery.coverage(d.results), 0.7)


# reports

_fracs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@register("l1_factor_distribution", "select factor, count(*) filter (status = 'VALUE') as n_value, count(*) filter (status = 'NULL') as n_null, count(*) filter (status = 'STALE') as n_stale, count(*) filter (status = 'SOURCE_ERROR') as n_error, " + ", ".join(f"round(max(raw_value) filter (status = 'VALUE' and rn = cast(round_even({f} * (n - 1), 0) as int)), 6) as {k}" for k, f in _fracs.items())
    + ", round(min(raw_value) filter (status = 'VALUE'), 6) as least, round(max(raw_value) filter (status = 'VALUE'), 6) as most from (select *, row_number() over (partition by factor, status order by raw_value) - 1 as rn, count(*) over (partition by factor, status) as n from panel) group by factor")
def _(d: Day):
    out = reports.distribution(d.panel, _fracs)
    return out.select("factor", "n_value", "n_null", "n_stale", "n_error", *[r6(k) for k in [*_fracs, "least", "most"]])


@register("l2_boundary_samples", """select strategy, entity, segment, w.factor, p.status, round(case when p.status = 'VALUE' then p.raw_value end, 6) as raw_value from (select strategy, entity, min(segment) as segment from (
  select strategy, entity, 'a_top' as segment from (select *, row_number() over (partition by strategy order by rank_percentile desc, entity) as k from res where rank_percentile is not null) where k <= 5 union all
  select strategy, entity, 'b_above' from (select *, row_number() over (partition by strategy order by rank_percentile, entity) as k from res where rank_percentile >= 0.9) where k <= 5 union all
  select strategy, entity, 'c_below' from (select *, row_number() over (partition by strategy order by rank_percentile desc, entity) as k from res where rank_percentile < 0.9) where k <= 5) group by strategy, entity) join weights w using (strategy) left join panel p using (entity, factor)""")
def _(d: Day):
    found = reports.with_values(reports.boundary_samples(d.results), d.panel, d.weights)
    return found.select("strategy", "entity", "segment", "factor", "status", r6("raw_value"))


@register("l3_score_quantiles", "select strategy, " + ", ".join(f"round(max(score) filter (rn = least(n - 1, cast(floor(n * {f}) as int))), 6) as {k}" for k, f in {"least": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "most": 1.0}.items()) + " from (select strategy, score, row_number() over (partition by strategy order by score) - 1 as rn, count(*) over (partition by strategy) as n from res where score is not null) group by strategy")
def _(d: Day):
    q = reports.score_quantiles(d.results)
    return q.select("strategy", *[r6(c) for c in ("least", "p25", "median", "p75", "most")])


@register("l4_boundary_line", "select strategy, round(rank_percentile, 6) as rank_percentile, round(score, 6) as score, entity from (select *, row_number() over (partition by strategy order by rank_percentile, entity) as k from res where rank_percentile >= 0.9) where k = 1")
def _(d: Day):
    return reports.boundary_line(d.results).select("strategy", r6("rank_percentile"), r6("score"), "entity")


@register("l5_industry_distribution", "select r.strategy, coalesce(i.industry_name, 'UNKNOWN') as industry_name, count(*) as n from res r left join industry i on i.entity = r.entity and i.industry_id <> 3 where r.rank_percentile >= 0.9 group by 1, 2")
def _(d: Day):
    return reports.industry_distribution(d.results, d.view("industry").withColumn("industry_name", F.when(F.col("industry_id") != 3, F.col("industry_name"))))


@register("l6_strategy_overlap", "select a.strategy as first, b.strategy as second, count(t.entity) as n from (select distinct strategy from weights) a join (select distinct strategy from weights) b on a.strategy < b.strategy left join (select x.strategy as s, y.strategy as u, x.entity from res x join res y using (entity) where x.rank_percentile >= 0.9 and y.rank_percentile >= 0.9) t on t.s = a.strategy and t.u = b.strategy group by 1, 2")
def _(d: Day):
    return reports.overlap(d.results, list(scoring.STRATEGIES))


@register("l7_sensitivity_counts", "select strategy, c.cut, count(*) filter (rank_percentile >= c.cut) as n from res cross join (values (0.8), (0.85), (0.9), (0.95)) v(x) cross join lateral (select cast(v.x as double) as cut) c where rank_percentile is not null group by 1, 2")
def _(d: Day):
    return reports.sensitivity(d.results, (0.8, 0.85, 0.9, 0.95))


@register("l8_anomaly_summary", "select factor, count(*) as n, round(min(raw_value), 6) as least, round(median(raw_value), 6) as median, round(max(raw_value), 6) as most from panel where status = 'VALUE' and factor in ('pe_ttm', 'pb', 'ret_20d') group by factor")
def _(d: Day):
    return reports.anomalies(d.panel, ["pe_ttm", "pb", "ret_20d"]).select("factor", "n", r6("least"), r6("median"), r6("most"))


@register("l9_status_counts", "select status, count(*) as n from panel group by status")
def _(d: Day):
    return d.panel.groupBy("status").agg(F.count("*").alias("n"))


@register("l10_mapping_coverage", "select count(*) as total, count(*) filter (entity % 7 = 0) as missing, round(count(*) filter (entity % 7 <> 0) / count(*), 6) as ratio from members")
def _(d: Day):
    return reports.mapping_coverage(d.members, d.view("industry").where("entity % 7 <> 0")).select("total", "missing", r6("ratio"))


@register("l11_population_record", f"select (select count(*) from securities) as listed, (select count(*) from ({_listing}) where failed = '') as prefiltered, (select count(*) from members) as researched, round((select count(*) from members) / (select count(*) from securities), 6) as ratio")
def _(d: Day):
    return reports.population(d.view("securities"), universe.prefilter(d.view("securities"), AS_OF, **LIMITS), d.members).withColumn("ratio", F.round("ratio", 6))


@register("l12_valuation_field_coverage", "select metric, count(*) as n, round(count(*) / (select count(*) from members), 6) as ratio from lv join members using (entity) where value is not null group by metric")
def _(d: Day):
    members = d.members  # settles the bars, which valuations then read
    latest = factors.asof_latest(d.view("valuations_wide"), AS_OF, period="valuation_date", known="valuation_date", metrics=testbed.VALUATION_METRICS)
    return reports.field_coverage(latest, members).select("metric", "n", r6("ratio"))


@register("l13_valuation_factor_coverage", "select factor, count(*) filter (status = 'VALUE') as n, count(*) as total from valuation_panel join members using (entity) group by factor")
def _(d: Day):
    return reports.factor_coverage(d.panel.where(F.col("factor").isin(*[n for n, _ in factors.VALUATIONS])), d.members)


@register("l14_scoreable_coverage", f"select w.strategy, count(distinct p.entity) - count(distinct p.entity) filter (p.status <> 'VALUE') as scoreable, count(*) filter (p.status <> 'VALUE') as blocking from weights w join inside p using (factor) where w.factor in ({_factor(*[n for n, _ in factors.VALUATIONS])}) group by w.strategy")
def _(d: Day):
    names = [n for n, _ in factors.VALUATIONS]
    return reports.scoreable(d.panel.join(d.members, "entity", "left_semi"), d.weights.where(F.col("factor").isin(*names)))


_paid = "(select d.* from dividends d join members using (entity) where d.announce_date <= date '2001-06-30')"


@register("l15_dividend_coverage", f"select (select count(*) from members) as members, count(distinct entity) as with_any, count(distinct entity) filter (status = 'implemented' and cash_per_10 > 0) as with_cash, count(distinct entity) filter (ex_date is not null) as with_ex_date, count(distinct entity) filter (record_date is not null) as with_record_date, count(*) as events, count(*) filter (status = 'plan') as plans, count(*) filter (status = 'implemented') as implemented, (select count(*) from members) - count(distinct entity) as missing from {_paid}")
def _(d: Day):
    return reports.dividend_coverage(d.view("dividends"), d.members, AS_OF)


@register("l15_without_dividends", "select s_suppkey as entity from supplier where s_suppkey not in (select entity from dividends where announce_date <= date '1994-12-31')")
def _(d: Day):
    return reports.without_dividends(d.view("dividends"), d.view("securities"), "1994-12-31")


_technical = ("ret_20d", "ret_60d", "proximity_52w_high", "avg_amount_20d")
_tenths = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@register("l16_signal_readiness", "select strategy, factor, count(raw_value) as n, count(*) - count(raw_value) as missing, " + ", ".join(f"round(max(raw_value) filter (rn = cast(round_even({f} * (k - 1), 0) as int)), 6) as {c}" for c, f in _tenths.items())
    + ", round(min(raw_value), 6) as least, round(max(raw_value), 6) as most, max(entity) filter (up = 1 and raw_value is not null) as lowest, max(entity) filter (down = 1 and raw_value is not null) as highest from (select *, row_number() over (w order by raw_value nulls last, entity) - 1 as rn, row_number() over (w order by raw_value nulls last, entity) as up, row_number() over (w order by raw_value desc nulls last, entity) as down, count(raw_value) over w as k from (select q.strategy, q.entity, f.factor, case when p.status = 'VALUE' then p.raw_value end as raw_value from qual q cross join (values "
    + ", ".join(f"('{t}')" for t in _technical) + ") f(factor) left join panel p on p.entity = q.entity and p.factor = f.factor where q.qualified) window w as (partition by strategy, factor)) group by strategy, factor")
def _(d: Day):
    out = reports.signal_readiness(d.qualified, d.panel, list(_technical), _tenths)
    return out.select("strategy", "factor", "n", "missing", *[r6(c) for c in (*_tenths, "least", "most")], "lowest", "highest")


@register("l17_qualification_impact", _impact)
def _(d: Day):
    return reports.impact(d.results, d.qualified)


@register("l17_qualified_list", "select strategy, entity, round(rank_percentile, 6) as rank_percentile from qual where qualified")
def _(d: Day):
    return d.qualified.where("qualified").select("strategy", "entity", r6("rank_percentile"))


@register("l17_failure_reasons", "select strategy, reason, count(*) as n from (select strategy, unnest(string_split(risks, ',')) as reason from qual where risks is not null) group by strategy, reason")
def _(d: Day):
    return reports.failure_reasons(d.qualified)


@register("l18_closest_to_boundary", """select strategy, entity, absolute_pass, round(distance, 6) as distance from (select *, row_number() over (partition by strategy, absolute_pass order by distance, entity) as k from (
  select a.strategy, a.entity, a.absolute_pass, min(least(coalesce(abs(p.raw_value - l.low) / abs(l.low), 1e300), coalesce(abs(p.raw_value - l.high) / abs(l.high), 1e300))) as distance
  from ab a join lim l using (strategy) join panel p on p.entity = a.entity and p.factor = l.factor and p.status = 'VALUE' group by 1, 2, 3)) where k <= 5""")
def _(d: Day):
    return reports.closest(d.qualified, d.panel, d.limits, 5).select("strategy", "entity", "absolute_pass", r6("distance"))


@register("l19_evidence_impact", """select q.strategy, count(*) as qualified, count(*) filter (ret_20d is not null and proximity_52w_high is not null and volume_ratio is not null and industry_id <> 3 and b.ret is not null) as complete,
    count(*) filter (industry_id is null or industry_id = 3) as no_industry, count(*) filter (b.ret is null) as no_benchmark, count(*) filter (volume_ratio is null) as no_volume, count(*) filter (ret_20d < -0.15) as breakdown,
    count(*) filter (not coalesce(ret_20d < -0.15, false) and ret_60d > 0.15 and ret_20d < -0.05) as trend_weaken,
    count(*) filter (not coalesce(ret_20d < -0.15, false) and not coalesce(ret_60d > 0.15 and ret_20d < -0.05, false) and not coalesce(q.strategy = 'momentum' and (proximity_52w_high >= 0.95 or (ret_60d >= 0.2 and ret_20d between 0 and 0.05) or (ret_20d >= 0.064 and proximity_52w_high between 0.85 and 0.95)), false)
      and not coalesce(q.strategy in ('value', 'dividend') and ((dividend_yield_ttm >= 3 and ret_20d > -0.05) or ret_20d between -0.05 and 0.02), false)) as no_signal
  from qual q left join ev e using (entity) left join industry i using (entity) cross join be b where q.qualified group by q.strategy""")
def _(d: Day):
    mapped = market.membership(d.view("industry"), AS_OF).where("industry_id <> 3")
    return reports.evidence_impact(d.qualified, d.evidence, mapped, market.benchmark_evidence(d.view("benchmark_bars"), AS_OF))
