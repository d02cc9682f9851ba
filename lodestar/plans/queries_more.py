"""Registered queries of text blocks, decision profiles, integrity rules and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import tables
from lodestar.operators import blocks, decisions, validate
from lodestar.plans.day import Day
from lodestar.plans.register import Register
from lodestar.plans.queries_data import _runs
from lodestar.sources import files, landing

register = Register()
QUERIES, ORACLES = register.queries, register.oracles


def _lines(rows: DataFrame, head: str, line) -> DataFrame:
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return rows.groupBy("entity").agg(F.concat(F.lit(head), body, F.lit("\nend\n")).alias("text")).select(F.col("entity").alias("doc_id"), "text")


_units = {"pe": "x", "total": "bn"}


def _valued(d: Day) -> DataFrame:
    """Rows of two kinds of texts: those of entities hold a table, those of customers only a header."""
    line = F.concat(F.lit("| "), F.replace(F.col("trade_date").cast("string"), F.lit("-"), F.lit("")), F.lit(" | "), F.format_number(F.col("volume") * 1000, 0), F.lit(" |"))
    texts = _lines(d.bars_by_entity, "**grade**: A, good\n**total**: 1,234.5\n| date | pe |\n|---|---|\n", line)
    bare = d.view("customer").select((-1 - F.col("c_custkey")).alias("doc_id"), F.concat(F.lit("**total**: "), F.format_number("c_acctbal", 2)).alias("text"))
    # read three times: for cells, last days and pairs
    return blocks.valuation_rows(tables.settle(texts.unionByName(bare), "valued"), ("grade",), d.as_of, _units)


@register("b9_valuation_blocks", """select entity, 'pe' as metric, trade_date as day, volume * 1000 as value, cast(null as varchar) as text_value, 'x' as unit, false as query_dated from bars
  union all select entity, 'grade', max(trade_date), null, 'A, good', null, false from bars group by entity union all select entity, 'total', max(trade_date), 1234.5, null, 'bn', false from bars group by entity
  union all select -1 - c_custkey, 'total', date '2001-06-30', c_acctbal, null, 'bn', true from customer""")
def _(d: Day):
    return _valued(d)


@register("b9_absent_metrics", "select -1 - c_custkey as entity, unnest(['grade', 'pe']) as metric from customer")
def _(d: Day):
    return blocks.absent_metrics(_valued(d), ["grade", "pe", "total"])


@register("b10_payout_texts", "select 'E' || cast(entity as varchar) as section, ex_date, announce_date, cash_per_10, status, 'CNY' as currency from (select distinct entity, ex_date, announce_date, cash_per_10, status from dividends)")
def _(d: Day):
    rows = d.view("dividends").select("entity", "ex_date", "announce_date", "cash_per_10", "status").distinct()
    line = F.concat_ws(" | ", F.lit(""), F.col("announce_date").cast("string"), F.concat(F.lit("10派"), F.col("cash_per_10").cast("string"), F.lit("元")), F.when(F.col("status") == "plan", "董事会预案").otherwise("实施"), F.date_format("ex_date", "yyyyMMdd"))
    texts = _lines(rows, "intro\n", F.concat(F.trim(line), F.lit(" |")))
    head = F.concat(F.lit("# E"), F.col("doc_id").cast("string"), F.lit("\n货币单位：CNY\n| 公告日 | 分红方案 | 进度 | 除权日 |\n|---|---|---|---|"))
    return blocks.payout_events(texts.withColumn("text", F.regexp_replace("text", "intro", "@@")).withColumn("text", F.replace("text", F.lit("@@"), head)))


@register("b11_constituents", "select n_name as grp, 'S' || cast(s_suppkey as varchar) as entity, s_name as name from supplier join nation on n_nationkey = s_nationkey")
def _(d: Day):
    rows = d.view("industry").join(d.view("supplier").select(F.col("s_suppkey").alias("entity"), "s_name"), "entity")
    line = F.concat(F.lit("| S"), F.col("entity").cast("string"), F.lit(" | "), F.col("s_name"), F.lit(" |"))
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    texts = rows.groupBy(F.col("industry_name").alias("grp")).agg(F.concat(F.lit("members of "), F.first("industry_name"), F.lit("\n| code | name |\n|---|---|\n"), body).alias("text")).withColumn("doc_id", F.col("grp"))
    return blocks.constituents(texts)


_ctx = "(select i.entity, coalesce(c.entity is not null, false) as published, max(p.raw_value) filter (p.factor = 'ret_20d' and p.status = 'VALUE') as ret_20d, max(q.rank_percentile) as best from (select distinct entity from line) i left join chosen c on c.entity = i.entity left join panel p on p.entity = i.entity left join qual q on q.entity = i.entity group by 1, 2)"


def _context(d: Day) -> DataFrame:
    return decisions.context(d.view("line").select("entity").distinct(), d.panel, d.qualified, d.candidates)


@register("m2_context_join", f"select entity, published, round(ret_20d, 6) as ret_20d, round(best, 6) as best from {_ctx}")
def _(d: Day):
    return _context(d).select("entity", "published", F.round("ret_20d", 6).alias("ret_20d"), F.round("best", 6).alias("best"))


_two = "(select entity, max(close) filter (rn = 1) as entry, max(close) filter (rn = 2) as before, max(volume) filter (rn = 1) as volume from tb group by entity)"
#: What the intents say; the sign and size of their plans follow from the bars.
_plan = f"(select entity, entry, before, entry * 0.96 as stop, entry + (entry - before) as target, case when entity % 5 <> 0 then volume > 25 end as confirmed, case entity % 3 when 0 then 'close below' when 1 then '  ' end as invalidation from {_two})"


def _plans(d: Day) -> DataFrame:
    last = F.slice(F.sort_array(F.collect_list(F.struct("trade_date", "close", "volume"))), -2, 2)
    seen = d.view("bars").where(F.col("trade_date") <= F.lit(d.as_of).cast("date"))
    day = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("trade_date")))
    two = seen.withColumn("rn", day).where("rn <= 2").groupBy("entity").agg(last.alias("b"))
    entry, before = F.try_element_at("b", F.lit(-1)), F.try_element_at("b", F.lit(-2))
    rows = two.select("entity", entry["close"].alias("entry"), before["close"].alias("before"), entry["volume"].alias("volume"))
    k = F.col("entity")
    return rows.select(
        "entity", "entry", "before", (F.col("entry") * 0.96).alias("stop"), (F.col("entry") + (F.col("entry") - F.col("before"))).alias("target"),
        F.when(k % 5 != 0, F.col("volume") > 25).alias("confirmed"), F.when(k % 3 == 0, "close below").when(k % 3 == 1, "  ").alias("invalidation"),
    )


@register("m4_event_scores", f"""select * from (with p as (select *, round(entry / before - 1, 9) as r from {_plan}), g as (select p.*, i.industry_id from p left join industry i using (entity)),
  s as (select industry_id, round(avg(cast(r as decimal(18, 9))), 6) as sector from g where r is not null and industry_id is not null group by 1), b as (select round(avg(cast(r as decimal(18, 9))), 6) as bench from p)
  select entity, case when sector > bench then 1.0 when sector is not null then 0.0 end as sector_strength,
    round(case when r is null or sector is null then null when sector > 0 then case when r / sector > 1 then 1 when r / sector < 0 then 0 else r / sector end when r > sector then 1 else 0 end, 6) as relative_strength,
    case when confirmed then 1.0 when not confirmed then 0.0 end as price_confirmation, case when trim(coalesce(invalidation, '')) <> '' then 1.0 else 0.0 end as risk_plan
  from g left join s using (industry_id) cross join b)""")
def _(d: Day):
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,9)")), 6).cast("double")
    day = _plans(d).withColumn("stock_1d", F.round(F.col("entry") / F.col("before") - 1, 9)).join(d.view("industry").select("entity", "industry_id"), "entity", "left")
    sectors = day.where("stock_1d is not null").groupBy("industry_id").agg(mean("stock_1d").alias("sector_1d"))
    rows = day.join(sectors, "industry_id", "left").crossJoin(F.broadcast(day.agg(mean("stock_1d").alias("benchmark_1d"))))
    return decisions.event_ratios(rows).withColumn("relative_strength", F.round("relative_strength", 6))


_flagged = "case when {0} > 0 then 1.0 when {0} is not null then 0.0 end"


@register("m5_swing_scores", f"""select ev.entity, round(coalesce(q.best, r.best), 6) as fundamental_support, case va.validation when 'CONFIRMED' then 1.0 when 'NEUTRAL' then 0.5 when 'CONTRADICTED' then 0.0 end as sector_trend,
    ({_flagged.format('ev.ret_20d')} + {_flagged.format('ev.ret_60d')}) / 2 as stock_trend, case when confirmed then 1.0 when not confirmed then 0.0 end as key_level,
    round(case when ev.volume_ratio > 1 then 1 when ev.volume_ratio < 0 then 0 else ev.volume_ratio end, 6) as volume_confirmation, {_flagged.format('ev.relative_strength')} as relative_strength,
    round(case when target > entry and entry > stop then (target - entry) / (entry - stop) / (1 + (target - entry) / (entry - stop)) end, 6) as risk_reward
  from ev left join (select entity, max(rank_percentile) as best from qual group by entity) q using (entity) left join (select entity, max(rank_percentile) as best from res group by entity) r using (entity)
    left join va using (entity) left join {_plan} p using (entity)""")
def _(d: Day):
    out = decisions.swing_ratios(d.evidence, d.qualified, d.results, d.validated, _plans(d))
    return out.withColumns({c: F.round(c, 6) for c in ("fundamental_support", "volume_confirmation", "risk_reward")})


@register("m6_position_scores", f"""select ev.entity, {_flagged.format('ev.ret_60d')} as long_term_trend, round(financial_quality, 6) as financial_quality, round(earnings_growth, 6) as earnings_growth, round(valuation, 6) as valuation,
    case when p.entity is null then null when trim(coalesce(invalidation, '')) <> '' then 1.0 else 0.0 end as execution
  from ev left join (select entity, max(rank_percentile) filter (strategy = 'quality') as financial_quality, max(rank_percentile) filter (strategy in ('growth', 'garp')) as earnings_growth,
    max(rank_percentile) filter (strategy in ('value', 'garp')) as valuation from res where rank_percentile is not null group by entity) b using (entity) left join {_plan} p using (entity)""")
def _(d: Day):
    out = decisions.position_ratios(d.results, d.evidence, _plans(d))
    return out.withColumns({c: F.round(c, 6) for c in ("financial_quality", "earnings_growth", "valuation")})


@register("m12_integrity_rules", "select rule, count(*) as n from (select unnest(list_filter([case when (o_orderkey % 2 = 0) = (o_orderkey % 3 = 0) then 'ONE_OF_PLAN_AND_OVERRIDE' end, case when o_orderkey % 3 = 0 and o_totalprice > 100000 then 'CAP' end, case when o_orderkey % 3 = 0 and o_orderstatus = 'F' then 'NOT_ACKNOWLEDGED' end], lambda x: x is not null)) as rule from orders) group by rule")
def _(d: Day):
    k = F.col("o_orderkey")
    rows = d.view("orders").select(k.alias("id"), F.when(k % 2 == 0, k).alias("plan_id"), F.when(k % 3 == 0, k).alias("override_id"), F.col("o_totalprice").alias("amount"), F.lit(100000.0).alias("cap"), (F.col("o_orderstatus") != "F").alias("acknowledged"))
    return decisions.integrity(rows).groupBy("rule").agg(F.count("*").alias("n"))


_stages = ("1-URGENT", "2-HIGH", "3-MEDIUM", "PUBLISH")


@register("o6_run_manifest", f"""select * from (with m as (select cast(o_orderdate as date) as day, o_orderpriority as stage, case when o_orderkey % 17 = 0 then 'LOST' when o_orderkey % 5 = 0 then 'FAILED' when o_orderkey % 5 = 1 then 'BLOCKED' when o_orderkey % 5 = 2 then 'RUNNING' else 'SUCCESS' end as status,
    case when o_orderkey % 13 = 0 then cast(o_orderdate as date) + 1 else cast(o_orderdate as date) end as started, case when not (o_orderkey % 5 = 2 and o_orderkey % 7 <> 0) then cast(o_orderdate as date) end as finished, o_orderkey % 5 in (0, 1) and o_orderkey % 11 <> 0 as failed from orders)
  select 'UNKNOWN_STAGE' as rule, count(*) as n from m where stage not in {_stages} union all select 'STATUS', count(*) from m where status = 'LOST'
  union all select 'DUPLICATE_STAGE', (select count(*) from m where stage is not null) - (select count(*) from (select distinct day, stage from m where stage is not null))
  union all select 'MISSING_STAGE', {len(_stages)} * (select count(distinct day) from m) - (select count(*) from (select distinct day, stage from m where stage in {_stages}))
  union all select 'FINISHED', count(*) from m where (status = 'RUNNING' and finished is not null) or (status in ('SUCCESS', 'FAILED', 'BLOCKED') and finished is null)
  union all select 'ERROR', count(*) from m where (status in ('FAILED', 'BLOCKED') and not failed) or (status in ('SUCCESS', 'RUNNING') and failed) union all select 'TIME', count(*) from m where finished < started)""")
def _(d: Day):
    k, day = F.col("run_id"), F.col("day")
    named = _runs(d).join(d.view("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("stage")), "run_id")
    log = named.select("day", "stage", F.when(k % 17 == 0, "LOST").otherwise(F.col("status")).alias("status"), F.when(k % 13 == 0, F.date_add(day, 1)).otherwise(day).alias("started_at"), F.col("finished_at").cast("date").alias("finished_at"), "error")
    return validate.manifest_findings(log, list(_stages))


@register("o7_version_citations", "select factor, count(*) filter (len(factor) % 3 = 0) as bad from panel group by factor")
def _(d: Day):
    cited = d.panel.withColumn("version", F.when(F.length("factor") % 3 == 0, "v9").otherwise("v2"))
    return validate.uncited(cited, "version", "v1,v2,v3").groupBy("factor").agg(F.count_if("bad").alias("bad"))


@register("a27_strict_series", "select trade_date, close from bars where entity = 7 and trade_date <= date '2001-06-30'")
def _(d: Day):
    return files.strict_series(d.view("bars"), 7, d.as_of)


@register("a28_typed_sink", "select entity, cast(count(*) as bigint) as n, cast(min(close) as decimal(12,4)) as low from bars group by entity")
def _(d: Day):
    path = tables.fresh_path(d.spark, "typed")
    files.write_typed(d.view("bars"), path, "entity bigint, trade_date date, close decimal(12,4)")
    return d.spark.read.parquet(path).groupBy("entity").agg(F.count("*").alias("n"), F.min("close").alias("low"))


@register("a22_sorted_lines", "select entity, count(*) as n from bars group by entity")
def _(d: Day):
    path = tables.fresh_path(d.spark, "lines")
    files.write_lines(d.view("bars").select("entity", "trade_date", "close"), path, ["entity", "trade_date"])
    return d.spark.read.schema("entity bigint, trade_date date, close double").json(path).groupBy("entity").agg(F.count("*").alias("n"))


@register("a19_snapshot_read", "select strategy, count(*) as n from res group by strategy")
def _(d: Day):
    top = tables.fresh_path(d.spark, "snapshots")
    landing.write_snapshot(d.results, top, "strategy", d.as_of)
    empty = files.read_snapshot(d.spark, top, "strategy", "1990-01-01", "strategy string")
    return files.read_snapshot(d.spark, top, "strategy", d.as_of, "strategy string").unionByName(empty).groupBy("strategy").agg(F.count("*").alias("n"))
