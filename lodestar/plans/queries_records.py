"""Registered queries of texts, merges, commits, lineage and replay over rows made odd by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import tables
from lodestar.operators import artifacts, bundle, candidates, decisions, factors, gates, lifecycle, lineage, normalize, trades
from lodestar.plans import testbed
from lodestar.plans.day import VETO_BELOW, Day
from lodestar.plans.register import Register
from lodestar.sources import commits, files, landing

register = Register()
QUERIES, ORACLES = register.queries, register.oracles


# landing


_told = "case when entity % 4 = 0 then null when entity % 4 = 1 and extract(day from trade_date) > 28 then null when entity % 4 = 2 then 'E' || cast(entity as varchar) else cast(trade_date as varchar) end"


@register("a2_values_of_entities", f"select entity, case when count(x) = count(*) and min(x) = max(x) then min(x) end as told from (select entity, {_told} as x from bars) group by entity")
def _(d: Day):
    day, kind = F.col("trade_date"), F.col("entity") % 4
    told = F.when((kind == 0) | ((kind == 1) & (F.dayofmonth(day) > 28)), None).when(kind == 2, F.concat(F.lit("E"), F.col("entity").cast("string"))).otherwise(day.cast("string"))
    return landing.single_value(d.view("bars").withColumn("told", told), "told", ["entity"])


_old = "select nullif(entity, 7) as entity, trade_date, close from bars"
_new = "select nullif(entity, 7) as entity, trade_date, close * 2 as close, volume from bars where entity % 7 = 0 and trade_date >= date '2000-01-01'"


def _with_null_keys(d: Day) -> tuple[DataFrame, DataFrame]:
    bars = d.view("bars").withColumn("entity", F.nullif("entity", F.lit(7)))
    kept = d.view("bars").where("entity % 7 = 0 and trade_date >= date '2000-01-01'").withColumn("entity", F.nullif("entity", F.lit(7)))
    return bars.select("entity", "trade_date", "close"), kept.select("entity", "trade_date", (F.col("close") * 2).alias("close"), "volume")


@register("a5_null_keys", f"select entity, trade_date, round(close, 4) as close, cast(null as double) as volume from ({_old}) o where not exists (select 1 from ({_new}) n where n.entity is not distinct from o.entity and n.trade_date = o.trade_date) union all select entity, trade_date, round(close, 4), volume from ({_new})")
def _(d: Day):
    return landing.merge(*_with_null_keys(d), ["entity", "trade_date"]).withColumn("close", F.round("close", 4))


@register("a5_written_and_total", f"select (select count(*) from ({_new})) as written, (select count(*) from bars) as total, (select count(*) from ({_new})) as doubled")
def _(d: Day):
    old, new = _with_null_keys(d)
    path = tables.fresh_path(d.spark, "merged")
    old.write.parquet(path)
    written, total = landing.merge_into(path, new, ["entity", "trade_date"])
    rows = d.spark.read.parquet(path)
    return rows.agg(F.lit(written).cast("long").alias("written"), F.lit(total).cast("long").alias("total"), F.count("volume").alias("doubled"))


_label = "case user_id % 3 when 0 then '**标的代码（统一输出字段名）**：E' || cast(user_id as varchar) || ' x\\n**板块代码**: B1' when 1 then '**板块代码**: B' || cast(user_id % 30 as varchar) else 'text of ' || cast(user_id as varchar) end"
_about = "case user_id % 3 when 0 then 'E' || cast(user_id as varchar) when 1 then 'B' || cast(user_id % 30 as varchar) else 'sha256 ' || sha256('text of ' || cast(user_id as varchar)) end"


@register("a7_identity_from_text", f"select event_type as type, {_about} as about, arg_max(value, struct_pack(b := event_id % 2, s := event_id)) as value, min(struct_pack(b := event_id % 2, s := event_id)).s as first_seq from events group by 1, 2")
def _(d: Day):
    user = F.col("user_id")
    text = F.when(user % 3 == 0, F.concat(F.lit("**标的代码（统一输出字段名）**：E"), user.cast("string"), F.lit(" x\n**板块代码**: B1"))).when(user % 3 == 1, F.concat(F.lit("**板块代码**: B"), (user % 30).cast("string")))
    rows = d.view("events").select("event_id", "value", F.col("event_type").alias("type"), F.coalesce(text, F.concat(F.lit("text of "), user.cast("string"))).alias("content"), F.col("event_id").alias("position"))
    merged = landing.merge_blocks(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))
    return merged.select("type", landing.block_identity(F.col("type"), F.col("content"))["about"].alias("about"), "value", F.col("position.seq").alias("first_seq"))


_log = "select o_custkey % 50 as day, o_orderkey as run, 'S' || cast(o_orderkey % 9 as varchar) as stage, o_orderpriority as status from orders"


@register("a20_positions", f"""select * from (with l as ({_log}), o as (select * from l where run % 2 = 0), n as (select * from l where run % 2 = 1),
  f as (select day, stage, arg_max(status, run) as status, min(run) as first from o group by all), p as (select *, row_number() over (partition by day order by first) - 1 as position from f),
  g as (select day, stage, arg_max(status, run) as status, min(run) as first from n group by all), m as (select day, max(position) + 1 as next from p group by day)
  select p.day, p.stage, coalesce(g.status, p.status) as status, p.position from p left join g using (day, stage)
  union all select g.day, g.stage, g.status, coalesce(next, 0) + row_number() over (partition by g.day order by g.first) - 1 from g left join m using (day) where not exists (select 1 from p where p.day = g.day and p.stage = g.stage))""")
def _(d: Day):
    runs = d.view("orders").select((F.col("o_custkey") % 50).alias("day"), F.col("o_orderkey").alias("run"), F.concat(F.lit("S"), (F.col("o_orderkey") % 9).cast("string")).alias("stage"), F.col("o_orderpriority").alias("status"))
    empty = d.spark.createDataFrame([], "day long, run long, stage string, status string, position long")
    log = landing.upsert(empty, runs.where("run % 2 = 0"), "day", ["stage"], "run")
    return landing.upsert(log, runs.where("run % 2 = 1"), "day", ["stage"], "run").select("day", "stage", "status", "position")


@register("a18_writers_of_one_day", "select count(*) as n, 'written' as first, 'same' as again, true as other_refused, 1 as days from res")
def _(d: Day):
    top = tables.fresh_path(d.spark, "snapshots")
    told = [landing.write_snapshot(df, top, "strategy", d.as_of) for df in (d.results, d.results.repartition(5))]
    try:
        # of equal size and unlike in every row: where all are eligible, the eligible ones are the same table
        landing.write_snapshot(d.results.withColumn("eligible", ~F.col("eligible")), top, "strategy", d.as_of)
        refused = False
    except ValueError:
        refused = True
    days = len(landing.snapshot_days(d.spark, top, "strategy"))
    rows = commits.read(d.spark, f"{top}/kind=strategy/as_of={d.as_of}", "data")
    return rows.agg(F.count("*").alias("n"), F.lit(told[0]).alias("first"), F.lit(told[1]).alias("again"), F.lit(refused).alias("other_refused"), F.lit(days).alias("days"))


_tables = "region nation customer supplier part orders lineitem events benchmark".split()


@register("a23_mapping_round_trip", "select cast(entity as varchar) as entity, industry_name as grp from industry where entity % 2 = 0")
def _(d: Day):
    path = tables.fresh_path(d.spark, "mapping")
    rows = d.view("industry").select(F.col("entity").cast("string").alias("entity"), F.col("industry_name").alias("group"), F.col("entity").alias("n"))
    for df in (rows, rows.where("n % 2 = 0")):  # the second takes the place of the first
        files.write_mapping(df, path)
    return files.read_mapping(d.spark, path).withColumnRenamed("group", "grp")


@register("a25_inventory", " union all ".join(f"select '{t}' as name, (select count(*) from {t}) as n, (select string_agg(column_name, ',') from (describe {t})) as columns, 'ok' as state" for t in _tables))
def _(d: Day):
    found = files.inventory(d.spark, d.sf_dir, "*.parquet").withColumn("name", F.regexp_extract("path", r"/(\w+)\.parquet", 1)).where(F.col("name").isin(*_tables))
    return found.groupBy("name").agg(F.sum("rows").alias("n"), F.min(F.array_join("columns", ",")).alias("columns"), F.min("state").alias("state"))


@register("a28_rows_and_findings", "select part, n, first from (select 'rows' as part, count(*) as n, min(trade_date) as first from bars union all select 'findings', count(*), min(trade_date) from bars where close > 1000)")
def _(d: Day):
    folder, bars = tables.fresh_path(d.spark, "gated"), d.view("bars").select("entity", "trade_date", "close")
    for limit in (500, 1000):  # the second commit takes the place of the first
        files.write_gated(bars, folder, "entity long, trade_date date, close decimal(18,4)", bars.where(F.col("close") > limit).withColumn("rule", F.lit("HIGH")), limit=limit)
    parts = [commits.read(d.spark, folder, p).agg(F.lit(p).alias("part"), F.count("*").alias("n"), F.min("trade_date").alias("first")) for p in ("rows", "findings")]
    return parts[0].unionByName(parts[1])


# texts


def _odd_texts(d: Day) -> DataFrame:
    """A text for each entity: a table with rows of dashes and blanks, some without a bar at the end, prose with bars, a rule without bars, and pairs in and out of place."""
    bars, n = d.bars_by_entity, F.dayofmonth("trade_date") % 4
    cell = F.col("volume").cast("long").cast("string")
    line = F.when(n == 0, "| - | -- |").when(n == 1, "|  |  |").when(n == 2, F.concat(F.lit("| "), F.col("trade_date").cast("string"), F.lit(" | "), cell)).otherwise(F.concat(F.lit("  | "), F.col("trade_date").cast("string"), F.lit(" | "), cell, F.lit(" |  ")))
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    head = F.lit("| no | table |\n| here | at all |\n\nprose with **inner**: pair\n  **count** (rows): ")
    tail = F.lit("\nend | of table |\n| only | a header |\n--- | ---\n**late** : x: y \n** **: none\n**open: z\n")
    text = F.concat(head, F.count("*").cast("string"), F.lit("\n| day | volume |\n|:--|--:|\n"), body, tail)
    return bars.groupBy("entity").agg(text.alias("text")).select(F.col("entity").alias("doc_id"), "text")


_n = "extract(day from trade_date) % 4"


@register("b7_odd_tables", f"""select entity as doc_id, 1 as table_no, case {_n} when 0 then '-' when 1 then '' else cast(trade_date as varchar) end as cell, 'day' as header, count(*) as n from bars group by all
  union all select entity, 1, case {_n} when 0 then '--' when 1 then '' else cast(cast(volume as bigint) as varchar) end, 'volume', count(*) from bars group by all""")
def _(d: Day):
    return normalize.table_cells(_odd_texts(d)).groupBy("doc_id", "table_no", "cell", "header").agg(F.count("*").alias("n"))


@register("b7_headers", "select entity as doc_id, unnest([1, 2]) as table_no, unnest(['day,volume', 'only,a header']) as columns, unnest([count(*), 0]) as n from bars group by entity")
def _(d: Day):
    return normalize.tables(_odd_texts(d)).select("doc_id", "table_no", F.array_join("columns", ",").alias("columns"), F.size("rows").cast("long").alias("n"))


@register("b8_pairs_of_lines", "select entity as doc_id, unnest(['count', 'late']) as key, unnest([cast(count(*) as varchar), 'x: y']) as value from bars group by entity")
def _(d: Day):
    return normalize.bold_pairs(_odd_texts(d))


# lineage: all entities with a qualified strategy stand as candidates, so that rules meet many rows


_version = "'v' || cast(length(factor) % 3 as varchar)"
_stamps = ", ".join(f"('{k}', '{v}')" for k, v in lineage.STRATEGY_VERSIONS.items())
_policy = lineage.POLICY_VERSIONS
#: A row for each strategy that an entity is qualified for, and for each factor that its result cites.
_cited = f"""ver as (select * from (values {_stamps}) v(strategy, version)), own as (select q.entity, q.strategy, v.version, q.rank_percentile from qual q join ver v using (strategy) where q.qualified),
  cf as (select o.entity, o.strategy, p.factor, {_version.replace('factor', 'p.factor')} as version, p.status, p.raw_value from own o join weights w using (strategy) join panel p on p.entity = o.entity and p.factor = w.factor)"""


def _versioned(d: Day) -> DataFrame:
    return d.panel.withColumn("factor_version", F.concat(F.lit("v"), (F.length("factor") % 3).cast("string")))


def _all_published(d: Day) -> DataFrame:
    """Candidates of all qualified entities, of factors in three versions; settled."""
    cited = lineage.cite_factors(d.results, _versioned(d), d.weights)
    return tables.settle(lineage.cite_results(candidates.build(d.assembled), d.qualified, cited), "published")


@register("j6_lineage", f"""select * from (with {_cited} select c.entity, (select string_agg(distinct version, ',' order by version) from cf where cf.entity = c.entity) as factor,
  (select string_agg(distinct version, ',' order by version) from own where own.entity = c.entity) as strategy, '{_policy["qualification"]}' as qualification, '{_policy["candidate_policy"]}' as policy_version,
  (select count(*) from own where own.entity = c.entity) as n_results, (select count(*) from cf where cf.entity = c.entity) as n_factors from ca c)""")
def _(d: Day):
    n = F.aggregate("results", F.lit(0).cast("long"), lambda a, r: a + F.size(r["cited"]))
    return _all_published(d).select("entity", "lineage.factor", "lineage.strategy", "lineage.qualification", "policy_version", F.size("results").cast("long").alias("n_results"), n.alias("n_factors"))


@register("j6_published", "select c.entity, c.primary_strategy, count(*) as n_results, '1' as factor, bool_and(q.qualified) as all_qualified from chosen c join qual q on q.entity = c.entity and q.qualified group by all")
def _(d: Day):
    held = F.forall("qualifications", lambda q: q["qualified"])
    return d.published.select("entity", "primary_strategy", F.size("results").cast("long").alias("n_results"), "lineage.factor", held.alias("all_qualified"))


@register("o2_planted_orphans", f"""select * from (with {_cited} select 'QUALIFIED' as "check", entity, strategy as observed from own where strategy = 'momentum' and entity % 3 = 0
  union all select 'STRATEGY', entity, strategy || ' ' || version from own where (strategy = 'momentum' and entity % 3 = 0) or entity % 7 = 0
  union all select distinct 'FACTOR', entity, factor || ' ' || version from cf where (factor = 'ret_20d' and entity % 4 = 0) or (factor = 'roe_ttm' and entity % 5 = 0))""")
def _(d: Day):
    stored = d.cited.where("not (strategy = 'momentum' and entity % 3 = 0)").withColumn("strategy_version", F.when(F.col("entity") % 7 == 0, "old").otherwise(F.col("strategy_version")))
    gone = _versioned(d).where("not (factor = 'ret_20d' and entity % 4 = 0)")
    panel = gone.withColumn("factor_version", F.when((F.col("factor") == "roe_ttm") & (F.col("entity") % 5 == 0), "v9").otherwise(F.col("factor_version")))
    return lineage.orphans(_all_published(d), stored, panel)


@register("o2_nothing_dangles", "select count(*) as n, cast(0 as bigint) as findings from chosen")
def _(d: Day):
    found = lineage.orphans(d.published, d.cited, d.panel).unionByName(lineage.undeclared(d.published)).agg(F.count("*").alias("findings"))
    return d.published.agg(F.count("*").alias("n")).join(F.broadcast(found))


@register("o7_undeclared_versions", f"""select * from (with {_cited} select 'EMPTY' as "check", entity, 'strategy' as observed from ca where entity % 3 = 0 union all select 'EMPTY', entity, 'policy_version' from ca where entity % 5 = 0
  union all select 'STRATEGY', entity, strategy || ' ' || version from own where entity % 3 = 0 or (entity % 3 = 1 and strategy = 'value')
  union all select 'QUALIFICATION', entity, strategy || ' {_policy["qualification"]}' from own where entity % 4 = 0)""")
def _(d: Day):
    kind, told = F.col("entity") % 3, F.col("lineage.strategy")
    listed = F.when(kind == 0, " , ").when(kind == 1, F.array_join(F.array_remove(F.split(told, ","), lineage.STRATEGY_VERSIONS["value"]), ", ")).otherwise(told)
    other = F.when(F.col("entity") % 4 == 0, "qualification-1").otherwise(F.col("lineage.qualification"))
    # with value alone the lineage of the second kind is empty too: such rows keep another version
    listed = F.when((kind == 1) & (told == lineage.STRATEGY_VERSIONS["value"]), "value-1").otherwise(listed)
    odd = _all_published(d).withColumn("lineage", F.col("lineage").withField("strategy", listed).withField("qualification", other))
    return lineage.undeclared(odd.withColumn("policy_version", F.when(F.col("entity") % 5 == 0, " ").otherwise(F.col("policy_version"))))


@register("l11_population_versions", f"""select * from (with {_cited} select 'strategy_version' as kind, (select string_agg(version, ',' order by version) from ver where strategy in (select strategy from res)) as versions, cast(0 as bigint) as n
  union all select 'factor_versions', 'v0,v1,v2', (select count(*) from res where entity % 6 = 0))""")
def _(d: Day):
    cited = lineage.cite_factors(d.results, _versioned(d).where("entity % 6 <> 0"), d.weights)
    rows = cited.withColumn("factor_versions", F.explode(F.when(F.size("cited") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct("cited.factor_version"))))
    return lineage.versions_of(rows, ["factor_versions"]).unionByName(lineage.versions_of(cited, ["strategy_version"]))


# replay


@register("o3_planted_offences", f"""select * from (with {_cited} select 'COUNT' as "check", cast(null as bigint) as entity, cast(n as varchar) as observed from (select count(*) as n from ca) where n > 50
  union all select 'CONTRADICTED', entity, validation from ca where validation = 'CONTRADICTED' union all select 'BREAKDOWN', entity, signal from ca where signal = 'BREAKDOWN'
  union all select 'ACTION', entity, signal || ' BUY' from ca where signal in ('TREND_WEAKEN', 'NO_SIGNAL') and entity % 4 = 0
  union all select 'RISK', entity, signal from ca where signal = 'TREND_WEAKEN' and entity % 2 = 0
  union all select 'NONE_QUALIFIED', entity, '' from ca where entity % 9 = 0
  union all select 'NO_RESULT', entity, strategy from own where entity % 5 = 0 and entity % 9 <> 0
  union all select 'PRIMARY', entity, trim('garp ' || case when entity % 9 = 0 then '' else primary_strategy end) from ca where entity % 3 = 0 and entity % 9 <> 0 and primary_strategy <> 'garp')""")
def _(d: Day):
    n = F.col("entity")
    odd = _all_published(d).withColumns({
        "action": F.when(n % 4 == 0, "BUY").otherwise(F.col("action")),
        "risks": F.when(n % 2 == 0, F.array(F.lit("other"))).otherwise(F.col("risks")),
        "primary_strategy": F.when(n % 3 == 0, "garp").otherwise(F.col("primary_strategy")),
        "qualifications": F.transform("qualifications", lambda q: q.withField("qualified", n % 9 != 0)),
        "results": F.when(n % 5 == 0, F.slice("results", 1, 0)).otherwise(F.col("results")),
    })
    return artifacts.candidate_rules(odd)


@register("o3_liquidity_replay", f"""select * from (with {_cited}, am as (select entity, avg_amount_20d as amount from pm) select 'LIQUIDITY' as "check", c.entity from ca c join am using (entity) where amount < {VETO_BELOW}
  union all select 'AMOUNT', c.entity from ca c join am using (entity) where c.entity % 6 = 0)""")
def _(d: Day):
    # every candidate cites its amount; a sixth of them half as much again
    amount = d.panel.where("factor = 'avg_amount_20d'").select("entity", F.struct("factor", "factor_version", "status", (F.col("raw_value") * F.when(F.col("entity") % 6 == 0, 1.5).otherwise(1.0)).alias("raw_value")).alias("f"))
    rows = d.assembled.join(amount, "entity").select("entity", F.array(F.struct(F.array("f").alias("cited"))).alias("results"))
    return artifacts.liquidity_replay(rows, d.view("bars"), d.as_of, least=VETO_BELOW).select("check", "entity")


@register("o1_planted_records", """select 'RANGE' as "check", entity, 'score' as observed from res where entity % 9 = 0 and score > 0 union all select 'RANGE', entity, 'rank_percentile' from res where entity % 10 = 0 and rank_percentile is not null
  union all select 'REQUIRED', entity, 'strategy' from res where entity % 11 = 0 union all select 'UNKNOWN', entity, 'strategy' from res where entity % 11 <> 0 and entity % 13 = 0
  union all select 'TIME', entity, 'known_at' from res where entity % 17 = 0 or entity % 19 = 0""")
def _(d: Day):
    n, day = F.col("entity"), F.lit(d.as_of).cast("timestamp")
    odd = d.results.withColumns({
        "score": F.when(n % 9 == 0, F.col("score") + 100).otherwise(F.col("score")),
        "rank_percentile": F.when(n % 10 == 0, F.lit(float("nan")) + F.col("rank_percentile")).otherwise(F.col("rank_percentile")),
        "strategy": F.when(n % 11 == 0, " ").when(n % 13 == 0, "other").otherwise(F.col("strategy")),
        "known_at": F.when(n % 17 == 0, None).when(n % 19 == 0, day + F.expr("interval 1 second")).otherwise(day),
    })
    found = artifacts.record_rules(odd, ranges={"score": (0.0, 100.0), "rank_percentile": (0.0, 1.0)}, required=["strategy"], vocabularies={"strategy": list(lineage.STRATEGY_VERSIONS)}, moment="known_at", as_of=d.as_of)
    return found.withColumn("observed", F.substring_index("observed", " ", 1))


@register("o1_cited_scores", """select * from (with own as (select entity, strategy from qual where qualified) select 'SCORE' as "check", entity, strategy as observed from own where entity % 3 = 0 union all select 'PERCENTILE', entity, strategy from own where entity % 4 = 0)""")
def _(d: Day):
    n = F.col("entity")
    odd = F.transform("results", lambda r: r.withField("score", F.when(n % 3 == 0, -1.0).otherwise(r["score"])).withField("rank_percentile", F.when(n % 4 == 0, 1.5).otherwise(r["rank_percentile"])))
    return artifacts.cited_scores(_all_published(d).withColumn("results", odd)).withColumn("observed", F.substring_index("observed", " ", 1))


@register("o1_availability", "select entity, count(*) as n from (select *, entity % 3 as k, announce_date > date '2001-06-30' as late from observations) where k = 0 or (k = 1 and late) group by entity")
def _(d: Day):
    kind, known = F.col("entity") % 3, normalize.available_at(F.col("announce_date"), "UTC")
    ref = F.struct("metric", F.when(kind < 2, F.col("report_period")).alias("period"), F.when(kind == 1, known).alias("known_at"))
    rows = testbed.observations(d.spark, d.sf_dir).groupBy("entity", "report_period").agg(F.collect_list(ref).alias("refs"))
    return artifacts.availability(rows, f"{d.as_of} 23:59:59").groupBy("entity").agg(F.count("*").alias("n"))


@register("e11_whole_refs", """select r.entity, r.metric, lo.period, round(lo.value, 6) as value, lo.known, case r.metric when 'roe_ttm' then '%' end as unit, 'statements' as source, 's-1' as version, extract(hour from lo.known + interval 7 hour) as hour
  from (select distinct entity, metric from observations) r left join lo using (entity, metric)""")
def _(d: Day):
    refs = factors.evidence(testbed.observations(d.spark, d.sf_dir), d.as_of, source="statements", units={"roe_ttm": "%"}, version="s-1")
    return refs.select("entity", F.inline("refs")).select("entity", "metric", "period", F.round("value", 6).alias("value"), "known", "unit", "source", "version", F.hour("known_at").cast("long").alias("hour"))


@register("o4_regimes", """select 'ONE' as "check", cast(null as bigint) as entity, cast(count(*) as varchar) as observed from region having count(*) <> 1 union all select 'REGIME', null, r_name from region where r_name <> 'ASIA'""")
def _(d: Day):
    rows = d.view("region").select(F.when(F.col("r_name") == "ASIA", "BULL").otherwise(F.col("r_name")).alias("regime"))
    return artifacts.regime_rules(rows.unionByName(d.regime.select("regime").limit(0)))


# trades


#: Intents of many days: every fifth day of the month, at an hour that follows from the entity.
_intent = "(select entity * 100000 + date_diff('day', date '1990-01-01', trade_date) as intent_id, entity, trade_date as as_of, cast(trade_date as timestamp) + to_hours(cast(entity % 24 as int)) as at, close, volume from bars where extract(day from trade_date) % 5 = 0 and trade_date >= date '1996-01-01')"
#: What each day stored: returns of 20 bars, results of two strategies, candidates from 1997 on (in 1996 none is published) and overlays at 6 and at 12.
_ret = "(select entity, trade_date, case when count(close) over w = 21 and first(close) over w <> 0 then close / first(close) over w - 1 end as ret from bars window w as (partition by entity order by trade_date rows between 20 preceding and current row))"


def _intents(d: Day) -> DataFrame:
    rows = d.view("bars").where("day(trade_date) % 5 = 0 and trade_date >= date '1996-01-01'")
    at = F.timestamp_add("HOUR", (F.col("entity") % 24).cast("int"), F.col("trade_date").cast("timestamp"))
    return rows.select((F.col("entity") * 100000 + F.datediff("trade_date", F.lit("1990-01-01").cast("date"))).alias("intent_id"), "entity", F.col("trade_date").alias("as_of"), at.alias("at"))


def _contexts(d: Day) -> DataFrame:
    from lodestar.operators.factors import panel_returns

    bars, n, day = d.view("bars"), F.col("entity"), F.col("trade_date")
    panel = panel_returns(bars).select(day.alias("as_of"), "entity", F.lit("ret_20d").alias("factor"), F.when(F.col("ret").isNull(), "NULL").otherwise("VALUE").alias("status"), F.col("ret").alias("raw_value"))
    ratio = bars.where(n % 3 == 0).select(day.alias("as_of"), "entity", F.lit("volume_ratio").alias("factor"), F.when(n % 2 == 0, "VALUE").otherwise("STALE").alias("status"), (F.col("volume") / 10).alias("raw_value"))
    both = F.explode(F.array(F.lit("value"), F.lit("garp")))
    results = bars.where(n % 4 != 0).select(day.alias("as_of"), "entity", both.alias("strategy"), F.col("close").alias("score"), F.lit(0.5).alias("rank_percentile"))
    chosen = bars.where((n % 5 == 0) & (day >= F.lit("1997-01-01").cast("date"))).select(day.alias("as_of"), "entity", F.lit("NEUTRAL").alias("validation"), F.lit("NO_SIGNAL").alias("signal"), F.lit("policy-2").alias("lineage"))
    # a snapshot of candidates without rows is a snapshot
    kinds = F.explode(F.when(day >= F.lit("1997-01-01").cast("date"), F.array(F.lit("factor"), F.lit("candidate"))).otherwise(F.array(F.lit("factor"))))
    published = bars.select(day.alias("as_of")).distinct().select(F.col("as_of").alias("trade_date")).select(kinds.alias("kind"), day.alias("as_of"))
    hour = F.explode(F.array(F.lit(6), F.lit(12)))
    overlays = bars.where(n % 2 == 1).withColumn("hour", hour).select(
        "entity", F.timestamp_add("HOUR", F.col("hour"), day.cast("timestamp")).alias("seen_at"), (F.col("close") / 1000).alias("stock_1d"), F.lit(0.01).alias("sector_1d"), F.lit(0.0).alias("benchmark_1d"),
        (F.col("hour") == 12).alias("confirmed"), (F.col("volume") * F.col("hour")).alias("volume_ratio_now"), F.col("close").alias("price"),
    )
    return trades.context(_intents(d), panel.unionByName(ratio), results, chosen, overlays, published)


@register("m2_contexts_of_days", f"""select i.intent_id, round(r.ret, 6) as ret_20d, case when i.entity % 4 <> 0 then 2 else 0 end as n_strategies, case when i.as_of < date '1997-01-01' then 'not_published' when i.entity % 5 = 0 then 'published' else 'not_selected' end as candidate_status,
    case when i.as_of >= date '1997-01-01' and i.entity % 5 = 0 then 'NO_SIGNAL' end as signal, case when i.entity % 2 = 1 and i.entity % 24 >= 12 then 12 when i.entity % 2 = 1 and i.entity % 24 >= 6 then 6 end as seen_hour
  from {_intent} i left join {_ret} r on r.entity = i.entity and r.trade_date = i.as_of""")
def _(d: Day):
    return _contexts(d).select("intent_id", F.round("ret_20d", 6).alias("ret_20d"), F.size("strategies").alias("n_strategies"), "candidate_status", "signal", F.hour("seen_at").alias("seen_hour"))


@register("m5_volume_fallback", f"""select intent_id, round(greatest(0, least(1, coalesce(case when entity % 6 = 0 then volume / 10 end, case when entity % 2 = 1 and entity % 24 >= 12 then volume * 12 when entity % 2 = 1 and entity % 24 >= 6 then volume * 6 end))), 6) as volume_confirmation
  from (select i.*, volume from {_intent} i) where entity % 6 = 0 or (entity % 2 = 1 and entity % 24 >= 6) union all select intent_id, null from {_intent} where not (entity % 6 = 0 or (entity % 2 = 1 and entity % 24 >= 6))""")
def _(d: Day):
    return _contexts(d).select("intent_id", F.round(decisions.volume_confirmation(F.col("volume_ratio"), F.col("volume_ratio_now")), 6).alias("volume_confirmation"))


#: Evaluations, plans, overrides and executions of orders; a third of the references are wrong.
_ev = "(select o_orderkey as id, case when o_orderstatus = 'F' then 'PASS' else 'WAIT' end as decision, o_totalprice as proposed from orders where o_orderkey % 7 <> 0)"


def _traded(d: Day) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o, k = d.view("orders"), F.col("o_orderkey")
    evaluations = o.where(k % 7 != 0).select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("WAIT").alias("decision"), F.col("o_totalprice").alias("proposed"))
    of = F.when(k % 3 == 0, k + 1).otherwise(k)  # every third belongs to another evaluation
    plans = o.where(k % 5 != 0).select((-k).alias("id"), of.alias("evaluation_id"))
    overrides = o.select(
        (-k).alias("id"), of.alias("evaluation_id"), F.when(k % 11 == 0, " ").otherwise("r").alias("reason"), F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence"),
        F.when(k % 17 != 0, "s").alias("stop_rule"), (k % 19 != 0).alias("acknowledged"), (k % 12).cast("int").alias("fomo"), F.lit(100000.0).alias("cap"),
    )
    kind = k % 4
    executions = o.select(
        k.alias("id"), k.alias("evaluation_id"), F.when((kind == 0) | (kind == 2), -k).alias("plan_id"), F.when((kind == 1) | (kind == 2), -k).alias("override_id"),
        F.when(k % 23 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("price"), F.when(k % 29 != 0, 1).alias("quantity"),
    )
    return evaluations, plans, overrides, executions


@register("m12_overrides_and_evaluations", f"""select * from (with o as (select -o_orderkey as id, o_orderkey as k, case when o_orderkey % 3 = 0 then o_orderkey + 1 else o_orderkey end as ev from orders), j as (select o.*, e.id as there, proposed from o left join {_ev} e on e.id = o.ev)
  select id, 'EVALUATION' as rule, cast(ev as varchar) as refers_to from j where there is null union all select id, 'CAP', cast(ev as varchar) from j where there is not null and not (100000 < proposed)
  union all select id, 'REASON', cast(ev as varchar) from j where k % 11 = 0 union all select id, 'EVIDENCE', cast(ev as varchar) from j where k % 13 = 0 union all select id, 'STOP', cast(ev as varchar) from j where k % 17 = 0
  union all select id, 'FOMO', cast(ev as varchar) from j where k % 12 = 11 union all select id, 'NOT_ACKNOWLEDGED', cast(ev as varchar) from j where k % 19 = 0)""")
def _(d: Day):
    evaluations, _, overrides, _ = _traded(d)
    return trades.override_findings(overrides, evaluations)


@register("m12_executions_and_references", f"""select * from (with x as (select o_orderkey as k, o_orderkey % 4 as kind, e.id as there, decision, (o_orderkey % 5 = 0 or o_orderkey % 3 = 0) as no_plan, o_orderkey % 3 = 0 as no_override from orders left join {_ev} e on e.id = o_orderkey)
  select k as id, 'EVALUATION' as rule, cast(k as varchar) as refers_to from x where there is null union all select k, 'ONE_OF', cast(k as varchar) from x where kind in (2, 3)
  union all select k, 'FILL', cast(k as varchar) from x where k % 23 = 0 or k % 29 = 0 union all select k, 'NOT_PASSED', cast(k as varchar) from x where kind = 0 and there is not null and decision <> 'PASS'
  union all select k, 'PLAN', cast(-k as varchar) from x where kind = 0 and no_plan union all select k, 'OVERRIDE', cast(-k as varchar) from x where kind = 1 and no_override)""")
def _(d: Day):
    evaluations, plans, overrides, executions = _traded(d)
    return trades.execution_findings(executions, evaluations, plans, overrides)


# expected against stored


_kinds = ["candidate", "factor", "regime", "strategy"]


@register("n4_missing_kinds", """select * from (with w as (select distinct cast(o_orderdate as date) as day, case o_orderkey % 5 when 0 then 'candidate' when 1 then 'factor' when 2 then 'regime' when 3 then 'strategy' end as kind from orders),
    l as (select cast(o_orderdate as date) as day, o_orderpriority as stage, case o_orderkey % 9 when 0 then 'FAILED' when 1 then 'BLOCKED' else 'SUCCESS' end as status from orders where o_orderkey % 3 = 0),
    h as (select day, string_agg(kind, ',' order by kind) as written, count(kind) as n from w where kind is not null group by day),
    r as (select day, string_agg(distinct stage, ',' order by stage) filter (status = 'BLOCKED') as blocked, string_agg(distinct stage, ',' order by stage) filter (status = 'FAILED') as failed, bool_and(status = 'SUCCESS') as fine from l group by day)
  select coalesce(h.day, r.day) as day, coalesce(written, '') as written, coalesce((select string_agg(k, ',' order by k) from (select unnest(['candidate', 'factor', 'regime', 'strategy']) as k) where not list_contains(string_split(coalesce(written, ''), ','), k)), '') as missing,
    coalesce(blocked, '') as blocked, coalesce(failed, '') as failed, coalesce(fine, false) and coalesce(n, 0) = 4 as complete from h full join r on r.day = h.day)""")
def _(d: Day):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate").alias("day")
    o = d.view("orders")
    written = o.select(F.get(F.array(*[F.lit(x) for x in _kinds]), (k % 5).cast("int")).alias("kind"), day)
    log = o.where(k % 3 == 0).select(day, F.col("o_orderpriority").alias("stage"), F.when(k % 9 == 0, "FAILED").when(k % 9 == 1, "BLOCKED").otherwise("SUCCESS").alias("status"))
    out = lifecycle.snapshot_report(written, _kinds, log)
    return out.select("day", *[F.array_join(c, ",").alias(c) for c in ("written", "missing", "blocked", "failed")], "complete")


@register("b13_bundle", """select * from (with b as (select entity, trade_date, case when entity % 9 = 0 then 'x' else cast(close as varchar) end as cell from bars where trade_date <= date '2001-06-30')
  select 'bars' as part, count(*) as n from b where cell <> 'x' union all select 'securities', count(*) from securities where entity % 2 = 0 union all select 'observations', count(*) from observations where metric = 'roe_ttm' and announce_date <= date '2001-06-30' and value is not null
  union all select 'failures', (select count(*) from bars where entity % 9 = 0) + (select count(*) from securities where entity % 2 = 1) union all select 'pending', count(*) from observations where metric = 'roe_ttm' and announce_date > date '2001-06-30' and value is not null
  union all select 'absent balance', 1 union all select 'absent cash', 1)""")
def _(d: Day):
    root, text = tables.fresh_path(d.spark, "raw"), lambda c: F.col(c).cast("string").alias(c)
    row = F.monotonically_increasing_id().alias("row")
    close = F.when(F.col("entity") % 9 == 0, "x").otherwise(F.col("close").cast("string"))
    d.bars_by_entity.select(row, text("entity"), text("trade_date"), close.alias("close"), *[text(c) for c in ("open", "high", "low", "volume", "amount")]).write.parquet(f"{root}/bars.parquet")
    flags = {"is_st": F.lit("no"), "is_delisting": F.when(F.col("entity") % 2 == 1, "perhaps").otherwise("no"), "suspended_days": F.lit("")}
    d.view("securities").select(row, text("entity"), F.lit("n").alias("name"), text("exchange"), text("list_date"), *[c.alias(n) for n, c in flags.items()]).write.parquet(f"{root}/securities.parquet")
    rows = d.by_entity("statements_wide").where("roe_ttm is not null").select(row, text("entity"), text("report_period"), text("announce_date"), F.col("roe_ttm").cast("string").alias("roe"))
    rows.write.parquet(f"{root}/income.parquet")
    rows.limit(0).write.parquet(f"{root}/cash.parquet")
    metrics = {"roe": ("roe_ttm", "percent")}
    b = bundle.assemble(d.spark, root, f"{d.as_of} 23:00:00+00:00", {"balance": metrics, "cash": metrics, "income": metrics})
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    parts = [count(b.bars, "bars"), count(b.securities, "securities"), count(b.observations, "observations"), count(b.failures, "failures"), b.pending.select(F.lit("pending").alias("part"), "n")]
    for name in b.absent:
        parts.append(d.spark.range(1).select(F.lit(f"absent {name}").alias("part"), F.lit(1).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("c5_guarded_rows", "select metric, count(*) as n, true as late_refused from observations where announce_date <= date '2001-06-30' group by metric")
def _(d: Day):
    rows = testbed.observations(d.spark, d.sf_dir).withColumn("known_at", normalize.available_at(F.col("announce_date")))
    moment, keys = f"{d.as_of}T23:59:59+08:00", ["entity", "metric", "report_period"]
    early = rows.where(F.col("announce_date") <= F.lit(d.as_of).cast("date"))
    try:
        gates.known_at(rows, moment, "known_at", keys).write.format("noop").mode("overwrite").save()
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "known after" in str(e)
    return gates.known_at(early, moment, "known_at", keys).groupBy("metric").agg(F.count("*").alias("n"), F.lit(refused).alias("late_refused"))
