"""Registered queries of landing, normalization, gates, decisions, lifecycle and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import tables
from lodestar.operators import decisions, gates, lifecycle, normalize, validate
from lodestar.plans import testbed
from lodestar.plans.day import Day
from lodestar.plans.register import Register
from lodestar.sources import landing

register = Register()
QUERIES, ORACLES = register.queries, register.oracles


# landing


@register("a1_filtered_scan", "select o_orderkey, o_totalprice from orders where o_custkey in (1, 2, 3, 5, 8, 13) and o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '2000-12-31'")
def _(d: Day):
    return landing.scan(d.spark, f"{d.sf_dir}/orders.parquet", [1, 2, 3, 5, 8, 13], "1996-01-01", "2000-12-31", key="o_custkey", day="o_orderdate").select("o_orderkey", "o_totalprice")


@register("a2_single_value", "select max(trade_date) as trade_date from (select distinct date '2001-06-30' as trade_date from panel)")
def _(d: Day):
    return landing.single_value(d.panel.withColumnRenamed("as_of", "trade_date"), "trade_date")


@register("a4_latest_partition", "select entity, close from bars where trade_date = (select max(trade_date) from bars where trade_date <= date '2001-06-30')")
def _(d: Day):
    return landing.latest_partition(d.view("bars"), d.as_of, "trade_date").select("entity", "close")


_old, _new = "select entity, trade_date, close from bars", "select entity, trade_date, close * 2 as close, volume from bars where trade_date >= date '2001-01-01'"


@register("a5_keyed_merge", f"select entity, trade_date, round(close, 4) as close, cast(null as double) as volume from ({_old}) o where not exists (select 1 from ({_new}) n where n.entity = o.entity and n.trade_date = o.trade_date) union all select entity, trade_date, round(close, 4), volume from ({_new})")
def _(d: Day):
    bars = d.view("bars")
    old = bars.select("entity", "trade_date", "close")
    new = bars.where("trade_date >= date '2001-01-01'").select("entity", "trade_date", (F.col("close") * 2).alias("close"), "volume")
    return landing.merge(old, new, ["entity", "trade_date"]).withColumn("close", F.round("close", 4))


@register("a6_fold_payloads", "select entity, trade_date, close, cast(null as double) as amount, 1 as part from bars union all select entity, trade_date, null, amount, 2 from bars")
def _(d: Day):
    bars = d.view("bars")
    return landing.fold([bars.select("entity", "trade_date", c, F.lit(n).alias("part")) for n, c in ((1, "close"), (2, "amount"))])


@register("a7_block_identity_merge", "select identity, arg_max(value, struct_pack(b := batch, s := seq)) as value, min(struct_pack(b := batch, s := seq)).s as first_seq from (select event_type || ':' || cast(user_id as varchar) as identity, value, cast(event_id % 3 as int) as batch, event_id as seq from events) group by identity")
def _(d: Day):
    blocks = d.view("events").select((F.col("event_id") % 3).cast("int").alias("batch"), F.col("event_id").alias("seq"), "event_type", "user_id", "value")
    out = landing.newest_blocks(blocks, F.concat_ws(":", "event_type", "user_id"))
    return out.select("identity", "value", F.col("first_seen.seq").alias("first_seq"))


@register("a8_landing_plan", "select s_suppkey as entity from supplier where s_suppkey not in (select entity from bars where trade_date = date '2001-06-29')")
def _(d: Day):
    return landing.missing(d.view("securities"), d.view("bars"), "2001-06-29")


@register("a9_range_coverage", "select entity from bars group by entity having min(trade_date) <= date '1995-02-01' and max(trade_date) >= date '2001-10-15'")
def _(d: Day):
    return landing.range_coverage(d.view("bars"), "1995-02-01", "2001-10-15")


@register("a10_bar_sufficiency", "select s.entity, count(b.close) as n, count(b.close) >= 450 as enough from securities s left join bars b on b.entity = s.entity and b.trade_date <= date '2001-06-30' group by s.entity")
def _(d: Day):
    return landing.sufficiency(d.view("bars"), d.view("securities"), d.as_of, 450)


@register("a12_gated_compaction", "select p_type, count(*) as n from part where p_size % 5 <> 2 group by p_type")
def _(d: Day):
    parts = d.view("part").withColumn("part", F.col("p_size") % 5)
    status = d.spark.range(4).select(F.col("id").cast("int").alias("part"), F.when(F.col("id") == 2, "FAILED").otherwise("SUCCESS").alias("status"))
    return landing.compact(parts, status).groupBy("p_type").agg(F.count("*").alias("n"))


@register("a13_distinct_entities", "select distinct c_mktsegment as entity from customer where c_mktsegment <> ''")
def _(d: Day):
    found = d.view("customer").where("c_mktsegment <> ''").select(F.col("c_mktsegment").alias("entity")).distinct()
    if found.isEmpty():
        raise ValueError("an empty population")
    return found


@register("a15_requested_gap", "select distinct s_suppkey as entity from supplier where s_suppkey not in (select entity from dividends where ex_date >= date '2001-11-01')")
def _(d: Day):
    return landing.gap(d.view("securities"), d.view("dividends").where("ex_date >= date '2001-11-01'"))


@register("a16_gap_ledger", """select round, cast(missing + landed as bigint) as requested, cast(landed as bigint) as landed, cast(missing as bigint) as missing, stop from (select *, count(stop) over (order by round rows between unbounded preceding and 1 preceding) as ended from (
  select *, case when landed = 0 then 'no_progress' when missing = 0 then 'covered' end as stop from (select r.round, coalesce(f.landed, 0) as landed, (select count(*) from supplier) - coalesce(sum(f.landed) over (order by r.round), 0) as missing
    from (select distinct year(trade_date) * 12 + month(trade_date) as round from bars) r left join (select round, count(*) as landed from (select entity, min(year(trade_date) * 12 + month(trade_date)) as round from bars group by entity) group by round) f using (round)))) where ended = 0""")
def _(d: Day):
    landed = d.view("bars").select("entity", (F.year("trade_date") * 12 + F.month("trade_date")).cast("long").alias("round"))
    return landing.gap_ledger(d.view("securities"), landed)


@register("a17_listing_union", "select cast(s_suppkey as varchar) || '.S' as entity, s_name as name, contains(s_name, '7') as is_flagged from supplier union all select cast(c_custkey as varchar) || '.C', c_name, contains(c_name, '7') from customer")
def _(d: Day):
    parts = [(d.view("supplier"), "s_suppkey", "s_name", "S"), (d.view("customer"), "c_custkey", "c_name", "C")]
    return landing.fold([df.select(F.concat(F.col(k).cast("string"), F.lit(f".{x}")).alias("entity"), F.col(n).alias("name"), F.contains(F.col(n), F.lit("7")).alias("is_flagged")) for df, k, n, x in parts])


@register("a21_ledger_append", "select o_orderkey as record_id, 'new' as kind from orders where o_orderkey % 10 = 3 union all select o_orderkey, 'conflict' from orders where o_orderkey % 10 in (4, 6)")
def _(d: Day):
    orders = d.view("orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("body"))
    k = F.col("record_id") % 10
    # 3 is new and sent twice, 4 differs from what is held, 5 equals it, 6 is new and sent with two contents
    sent = orders.where(k.isin(3, 4, 5, 6)).withColumn("body", F.when(k == 4, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    again = orders.where(k.isin(3, 6)).withColumn("body", F.when(k == 6, F.concat("body", F.lit("?"))).otherwise(F.col("body")))
    new, bad = landing.append_ledger(orders.where(~k.isin(3, 6)), sent.unionByName(again))
    return new.select("record_id", F.lit("new").alias("kind")).unionByName(bad.select("record_id", F.lit("conflict").alias("kind")))


@register("a21_history", "select id, trade_date from (select l_orderkey * 10 + l_linenumber as id, entity, trade_date from line) where entity = 7")
def _(d: Day):
    rows = d.view("line").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "entity", "trade_date")
    return landing.history(rows, "entity", 7, "trade_date").select("id", "trade_date")


@register("a14_entity_order", "select entity, count(*) as n, min(trade_date) as first from bars where year(trade_date) <> 1997 group by entity")
def _(d: Day):
    status = d.spark.range(1995, 2003).select(F.col("id").cast("int").alias("part"), F.when(F.col("id") == 1997, "FAILED").otherwise("SUCCESS").alias("status"))
    path = tables.fresh_path(d.spark, "compacted")
    landing.write_compacted(d.view("bars").withColumn("part", F.year("trade_date")), status, path, ["entity", "trade_date"])
    return d.spark.read.parquet(path).groupBy("entity").agg(F.count("*").alias("n"), F.min("trade_date").alias("first"))


@register("a24_freshness", "select 'bars' as dataset, count(*) as n, min(trade_date) as first, max(trade_date) as last, cast(0 as bigint) as unreadable from bars union all select 'documents', count(*), null, null, count(*) from documents")
def _(d: Day):
    return landing.freshness({"bars": (d.view("bars"), "trade_date"), "documents": (d.view("documents"), "lang")})


_b = "(select * from bars where entity % 10 <> 0)"
_checks = {"rows": "count(*)", "nulls.entity": "count(*) filter (entity is null)", "nulls.trade_date": "count(*) filter (trade_date is null)", "nulls.close": "count(*) filter (close is null)", "zeros.entity": "count(*) filter (entity = 0)", "zeros.close": "count(*) filter (close = 0)", "duplicate_keys": "count(*) - count(distinct (entity, trade_date))"}
_both = " union all ".join(f"select '{c}' as check, (select {f} from bars) as a_value, (select {f} from {_b}) as b_value" for c, f in _checks.items())


@register("a26_equivalence", f"select *, a_value = b_value as same from ({_both} union all select 'rows_only_here', (select count(*) from bars where entity % 10 = 0), 0)")
def _(d: Day):
    bars = d.view("bars").select("entity", "trade_date", "close")
    return landing.equivalence(bars, bars.where("entity % 10 <> 0"), ["entity", "trade_date"])


@register("a18_snapshot_fingerprint", "select count(*) as n, true as order_is_free, false as change_is_free from panel")
def _(d: Day):
    changed = d.panel.withColumn("raw_value", F.when((F.col("entity") == 7) & (F.col("factor") == "pb"), 0.5).otherwise(F.col("raw_value")))
    a, b, c = (landing.fingerprint(x) for x in (d.panel, d.panel.repartition(7), changed))
    joined = a.join(F.broadcast(b.select(F.col("digest").alias("b")))).join(F.broadcast(c.select(F.col("digest").alias("c"))))
    return joined.select("n", (F.col("digest") == F.col("b")).alias("order_is_free"), (F.col("digest") == F.col("c")).alias("change_is_free"))


# normalization

_cell = "case l_linenumber % 7 when 0 then ' - ' when 1 then 'abc' when 2 then 'inf' when 3 then 'N/A' when 4 then ' ' || cast(l_linenumber as varchar) || ' ' else cast(cast(l_quantity as int) as varchar) end"


def _raw(d: Day) -> DataFrame:
    n = F.col("l_linenumber") % 7
    cell = F.when(n == 0, " - ").when(n == 1, "abc").when(n == 2, "inf").when(n == 3, "N/A").when(n == 4, F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" "))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    entity = F.when(F.col("l_orderkey") % 31 == 0, "").otherwise(F.col("l_suppkey").cast("string"))
    day = F.when(F.col("l_orderkey") % 29 == 0, "not-a-date").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    return d.view("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), entity.alias("entity"), day.alias("trade_date"), cell.alias("close"))


@register("b1_cell_classification", f"select row, case when lower(trim(cell)) in ('-', 'n/a') or cell = 'abc' or cell = 'inf' then null else cast(trim(cell) as double) end as value, case cell when 'abc' then 'unparsable' when 'inf' then 'not_finite' end as reason from (select l_orderkey * 10 + l_linenumber as row, {_cell} as cell from lineitem) where cell not in ('abc', 'inf') or true".replace("cast(trim(cell) as double)", "try_cast(trim(cell) as double)"))
def _(d: Day):
    value, reason = normalize.classify(F.col("close"))
    return _raw(d).select("row", value.alias("value"), reason.alias("reason"))


@register("b2_bar_failures", f"select reason, count(*) as n from (select case when l_orderkey % 31 = 0 then 'entity_missing' when l_orderkey % 29 = 0 then 'date_invalid' when cell = 'abc' then 'unparsable' when cell = 'inf' then 'not_finite' end as reason from (select l_orderkey, {_cell} as cell from lineitem)) where reason is not null group by reason")
def _(d: Day):
    _, failures = normalize.bars(_raw(d), ["close"])
    return failures.groupBy("reason").agg(F.count("*").alias("n"))


@register("b3_flags", "select s_suppkey as entity, s_suppkey % 4 < 2 as flag from supplier")
def _(d: Day):
    n = F.col("s_suppkey") % 4
    cell = F.when(n == 0, " TRUE ").when(n == 1, "是").when(n == 2, "no").otherwise("0")
    return d.view("supplier").select(F.col("s_suppkey").alias("entity"), normalize.flag(cell).alias("flag"))


#: Cells of a dimension as a source may send them.
_security = {
    "entity": "case when s_suppkey % 41 = 0 then '  ' else ' ' || cast(s_suppkey as string) || ' ' end", "name": "case when s_suppkey % 43 = 0 then null else s_name end", "exchange": "'X'", "list_date": "case s_suppkey % 9 when 0 then '2001-02-30' when 1 then '20010203' else '2001-02-03' end",
    "is_st": "case s_suppkey % 5 when 0 then ' TRUE ' when 1 then '是' when 2 then 'no' when 3 then '0' else 'maybe' end", "is_delisting": "'N'", "suspended_days": "case s_suppkey % 6 when 0 then '' when 1 then null when 2 then '1.5' else ' 12 ' end",
}


def _security_cells(d: Day) -> DataFrame:
    return d.view("supplier").select(F.col("s_suppkey").alias("row"), *[F.expr(text).alias(c) for c, text in _security.items()])


@register("b3_security_rows", "select s_suppkey as row, cast(s_suppkey as varchar) as entity, s_suppkey % 5 in (0, 1) as is_st, false as is_delisting, date '2001-02-03' as list_date, case when s_suppkey % 6 > 2 then 12 end as suspended_days from supplier where s_suppkey % 41 <> 0 and s_suppkey % 43 <> 0 and s_suppkey % 9 > 1 and s_suppkey % 5 <> 4 and s_suppkey % 6 <> 2")
def _(d: Day):
    return normalize.securities(_security_cells(d))[0].select("row", "entity", "is_st", "is_delisting", "list_date", "suspended_days")


@register("b3_security_failures", "select s_suppkey as row, unnest(list_filter([case when s_suppkey % 41 = 0 then 'entity' end, case when s_suppkey % 43 = 0 then 'name' end, case when s_suppkey % 9 < 2 then 'list_date' end, case when s_suppkey % 5 = 4 then 'is_st' end, case when s_suppkey % 6 = 2 then 'suspended_days' end], lambda x: x is not null)) as column from supplier")
def _(d: Day):
    return normalize.securities(_security_cells(d))[1].select("row", "column")


_sheet = "(select l_orderkey * 10 + l_linenumber as row, l_orderkey % 31 = 0 as no_entity, l_orderkey % 29 = 0 as no_day, cast(l_shipdate as date) as day, l_linenumber % 7 as k, l_quantity as q from lineitem)"
_metrics = {"revenue": ("revenue_ttm", "yuan"), "margin": ("gross_margin", "percent"), "absent": ("goodwill", "yuan")}


def _sheets(d: Day):
    raw = _raw(d).withColumnRenamed("close", "revenue").withColumn("report_period", F.lit(" 1999-12-31 ")).withColumn("margin", F.lit("12.5"))
    return normalize.statements(raw.withColumnRenamed("trade_date", "announce_date"), _metrics, "1999-06-30 15:00:00+08:00")


_known = f"(select * from {_sheet} where not no_entity and not no_day and day <= date '1999-06-30')"


@register("b4_statements", f"select metric, unit, count(*) as n, count(v) as valued, cast(sum(v) as double) as total from (select 'revenue_ttm' as metric, 'yuan' as unit, case when k = 4 then 4 when k > 4 then q end as v from {_known} union all select 'gross_margin', 'percent', 12.5 from {_known}) group by 1, 2")
def _(d: Day):
    return _sheets(d)[0].groupBy("metric", "unit").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("total"))


@register("b4_statement_failures", f"select 'entity' as column, 'unreadable' as reason, count(*) filter (no_entity) as n from {_sheet} union all select 'announce_date', 'unreadable', count(*) filter (no_day and not no_entity) from {_sheet} union all select 'revenue', 'unparsable', count(*) filter (k = 1) from {_known} union all select 'revenue', 'not_finite', count(*) filter (k = 2) from {_known}")
def _(d: Day):
    return _sheets(d)[1].groupBy("column", "reason").agg(F.count("*").alias("n"))


@register("b4_statement_pending", f"select count(*) as pending from {_sheet} where not no_entity and not no_day and day > date '1999-06-30'")
def _(d: Day):
    return _sheets(d)[2]


@register("b4_statement_unpivot", "select metric, count(*) as n, count(value) as valued from observations group by metric")
def _(d: Day):
    from lodestar.plans import testbed

    return testbed.observations(d.spark, d.sf_dir).groupBy("metric").agg(F.count("*").alias("n"), F.count("value").alias("valued"))


@register("b5_availability_time", "select distinct announce_date, epoch_ms(cast(announce_date as timestamp)) / 1000 + 7 * 3600 as seconds from observations".replace("epoch_ms(cast(announce_date as timestamp)) / 1000", "date_diff('day', date '1970-01-01', announce_date) * 86400"))
def _(d: Day):
    rows = d.view("statements_wide").select("announce_date").distinct()
    return rows.select("announce_date", F.unix_seconds(normalize.available_at(F.col("announce_date"))).alias("seconds"))


@register("b6_entity_codes", "select s_suppkey as entity, case s_suppkey % 4 when 0 then lpad(cast(s_suppkey as varchar), 6, '0') || '.SH' when 1 then lpad(cast(s_suppkey as varchar), 6, '0') || '.SZ' when 2 then lpad(cast(s_suppkey as varchar), 6, '0') || '.BJ' end as canonical from supplier")
def _(d: Day):
    prefix = F.element_at(F.array(F.lit("sh"), F.lit("SZ"), F.lit("bj"), F.lit("xx")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    code = F.concat(prefix, F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    return d.view("supplier").select(F.col("s_suppkey").alias("entity"), normalize.canonical(code).alias("canonical"))


_some = "trade_date is not null"


def _blocks(d: Day) -> DataFrame:
    rows = d.bars_by_entity.where(_some)
    line = F.concat_ws(" | ", F.lit(""), F.col("trade_date").cast("string"), F.col("volume").cast("long").cast("string"), F.lit("--"))
    body = F.array_join(F.sort_array(F.collect_list(F.concat(F.trim(line), F.lit(" |")))), "\n")
    text = F.concat(F.lit("prose before\n\n**note**: first\n**count**: "), F.count("*").cast("string"), F.lit("\n| date | volume | other |\n|---|---|---|\n"), body, F.lit("\nprose after\n**note**: last | x\n"))
    return rows.groupBy("entity").agg(text.alias("text")).select(F.col("entity").alias("doc_id"), "text")


@register("b7_markdown_tables", f"select entity as doc_id, cast(trade_date as varchar) as cell, 'date' as header from bars where {_some} union all select entity, cast(cast(volume as bigint) as varchar), 'volume' from bars where {_some} union all select entity, '--', 'other' from bars where {_some}")
def _(d: Day):
    return normalize.table_cells(_blocks(d)).select("doc_id", "cell", "header")


@register("b8_bold_pairs", f"select entity as doc_id, 'note' as key, 'last | x' as value from bars where {_some} group by entity union all select entity, 'count', cast(count(*) as varchar) from bars where {_some} group by entity")
def _(d: Day):
    return normalize.bold_pairs(_blocks(d))


@register("b12_flatten_answer", "select c_custkey as doc_id, 't' as type, c_mktsegment as desc, cast(c_custkey as varchar) as content from customer union all select c_custkey, 'u', null, 'x' from customer")
def _(d: Day):
    inner = F.array(F.struct(F.lit("t").alias("type"), F.col("c_mktsegment").alias("desc"), F.col("c_custkey").cast("string").alias("content")), F.struct(F.lit("u").alias("type"), F.lit(None).cast("string").alias("desc"), F.lit("x").alias("content")))
    whole = F.to_json(F.struct(F.struct(F.struct(inner.alias("apiRecall")).alias("apiData")).alias("data")))
    return normalize.flatten_answer(d.view("customer").select(F.col("c_custkey").alias("doc_id"), whole.alias("json")))


# gates

_dirty = """(select entity, trade_date, case when (entity * 7 + day(trade_date)) % 53 = 0 then null when (entity + day(trade_date)) % 61 = 0 then -close else close end as close, case when (entity + day(trade_date)) % 47 = 0 then -volume else volume end as volume from bars
  union all select entity, trade_date, close, volume from bars where (entity * 3 + day(trade_date)) % 59 = 0)"""
_issues = f"(select entity, trade_date, unnest(list_filter([case when close is null then 'close_missing' end, case when close <= 0 then 'close_not_positive' end, case when volume < 0 then 'volume_negative' end, case when n > 1 then 'duplicate_primary_key' end], lambda x: x is not null)) as rule from (select *, count(*) over (partition by entity, trade_date) as n from {_dirty}))"


def _dirty_bars(d: Day) -> DataFrame:
    bars, day = d.view("bars").select("entity", "trade_date", "close", "volume"), F.dayofmonth("trade_date")
    close = F.when((F.col("entity") * 7 + day) % 53 == 0, None).when((F.col("entity") + day) % 61 == 0, -F.col("close")).otherwise(F.col("close"))
    volume = F.when((F.col("entity") + day) % 47 == 0, -F.col("volume")).otherwise(F.col("volume"))
    return bars.withColumn("close", close).withColumn("volume", volume).unionByName(bars.where((F.col("entity") * 3 + day) % 59 == 0))


@register("c1_bar_gate", f"select rule, count(*) as n from {_issues} group by rule")
def _(d: Day):
    return gates.bar_issues(_dirty_bars(d)).groupBy("rule").agg(F.count("*").alias("n"))


@register("c2_valid_rows", f"select entity, count(*) as n from {_dirty} b where not exists (select 1 from {_issues} i where i.entity = b.entity and i.trade_date = b.trade_date) group by entity")
def _(d: Day):
    dirty = _dirty_bars(d)
    return gates.valid_bars(dirty, gates.bar_issues(dirty)).groupBy("entity").agg(F.count("*").alias("n"))


_obs = "(select * from observations union all select * from observations where entity % 10 = 3 and metric = 'roe_ttm')"
_oissues = f"(select distinct entity, metric, report_period, case when n > 1 then 'duplicate_primary_key' when entity % 10 = 5 and metric = 'goodwill' then 'cell_unreadable' when value is null then 'value_missing' end as rule, case when n > 1 or (entity % 10 = 5 and metric = 'goodwill') then 'INVALID' else 'NULL' end as state from (select *, count(*) over (partition by entity, metric, report_period) as n from {_obs}))"


def _dirty_observations(d: Day) -> tuple[DataFrame, DataFrame]:
    from lodestar.plans import testbed

    rows = testbed.observations(d.spark, d.sf_dir)
    return rows.unionByName(rows.where("entity % 10 = 3 and metric = 'roe_ttm'")), rows.where("entity % 10 = 5 and metric = 'goodwill'").select("entity", "metric", "report_period")


@register("c3_observation_gate", f"select rule, state, count(*) as n from {_oissues} where rule is not null group by rule, state")
def _(d: Day):
    return gates.observation_issues(*_dirty_observations(d)).groupBy("rule", "state").agg(F.count("*").alias("n"))


@register("c4_usable_observations", f"select metric, count(*) as n from {_obs} o where not exists (select 1 from {_oissues} i where i.rule is not null and i.state = 'INVALID' and i.entity = o.entity and i.metric = o.metric and i.report_period = o.report_period) group by metric")
def _(d: Day):
    rows, failures = _dirty_observations(d)
    return gates.usable_observations(rows, gates.observation_issues(rows, failures)).groupBy("metric").agg(F.count("*").alias("n"))


@register("c5_point_in_time", "select count(*) as n from observations where announce_date > date '2001-06-30'")
def _(d: Day):
    from lodestar.plans import testbed

    return gates.look_ahead(testbed.observations(d.spark, d.sf_dir), d.as_of)


@register("c6_severity", f"select 'P2' as severity, count(*) as n, false as blocking from {_issues}")
def _(d: Day):
    return gates.by_severity(gates.bar_issues(_dirty_bars(d)))


# decisions

_intent = "(select l_orderkey * 10 + l_linenumber as id, cents / 100.0 / qty as entry, qty - 3 as quantity, cents / 100.0 / qty * (1 - (d - 1) / 100.0) as stop, 1000000.0 as nav, d, t, flag, entity, trade_date from line)"


def _intents(d: Day) -> DataFrame:
    price = F.col("cents").cast("double") / 100 / F.col("qty")
    return d.view("line").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), price.alias("entry"), (F.col("qty") - 3).alias("quantity"), (price * (1 - (F.col("d") - 1) / F.lit(100))).alias("stop"), F.lit(1000000.0).alias("nav"), "d", "t", "flag")


@register("m1_risk_columns", f"select array_to_string(list_filter([case when entry <= 0 then 'ENTRY' end, case when quantity <= 0 then 'QUANTITY' end, case when d <= 1 then 'STOP' end], lambda x: x is not null), ',') as violations, count(*) as n from {_intent} group by 1")
def _(d: Day):
    rows = decisions.risk_columns(_intents(d).withColumn("stop", F.when(F.col("d") <= 1, F.col("entry")).otherwise(F.col("stop"))))
    return rows.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


_names = tuple(dict.fromkeys(n for weights in decisions.PROFILES.values() for n in weights))
#: Ratios below 0, within and above 1, and some missing; n is the dimension's place.
_ratio = lambda n: f"case when (d + {n} + qty) % 29 = 3 then null when (t + {n}) % 16 = 7 then -0.5 else 0.7 + ((d * {n + 1} + t) % 9) / 20.0 end"
#: What the intents say besides, on both sides of every veto.
_context = {
    "profile": "case l_orderkey % 3 when 0 then 'EVENT' when 1 then 'SWING' else 'POSITION' end", "invalidation": "case when qty % 10 = 1 then '  ' else 'close below' end", "nav": "case when qty = 7 then 0 else 1000000 end",
    "quantity": "qty - 3", "validation": "case when d = 9 then 'CONTRADICTED' else 'NEUTRAL' end", "signal": "case when t = 8 and d = 1 then 'BREAKDOWN' else 'NO_SIGNAL' end", "action": "case when flag = 'R' then 'ADD' else 'OPEN' end",
    "losing": "d >= 5", "new_confirmation": "case when t > 2 then 'volume' end", "sector_1d": "case when t <> 5 then (d - 4) / 100.0 end", "stock_1d": "case when d <> 3 then (t - 3) / 100.0 end", "benchmark_1d": "case when qty <> 20 then 0.01 end",
    "confirmed": "case when qty % 11 <> 5 then qty % 4 <> 1 end", "target": "case when qty % 13 <> 6 then qty end", "fomo": "(d + t) % 11", "priced_in": "t = 4",
}
_given = "(select l_orderkey * 10 + l_linenumber as id, " + ", ".join(f"{sql} as {c}" for c, sql in _context.items()) + ", " + ", ".join(f"{_ratio(n)} as {c}" for n, c in enumerate(_names)) + ", d, t from line)"


def _scored(weights: dict) -> str:
    """A sum over the dimensions of each profile, as the oracle has it."""
    total = lambda ws: " + ".join(f"{w} * greatest(0, least(1, coalesce({c}, 0)))" for c, w in ws.items())
    return "round(case profile " + " ".join(f"when '{p}' then {total(ws)}" for p, ws in weights.items()) + " end, 6)"


_absent = "case profile " + " ".join(
    f"when '{p}' then list_filter([" + ", ".join(f"case when {c} is null then '{c}' end" for c in (*sorted(ws), *decisions.NEEDS[p])) + "], lambda x: x is not null)" for p, ws in decisions.PROFILES.items()) + " end"
_hard = """list_filter([case when trim(invalidation) = '' then 'NO_INVALIDATION' end, case when nav <= 0 or quantity <= 0 then 'NO_RISK_BUDGET' end, case when validation = 'CONTRADICTED' then 'UPSTREAM_MARKET_CONTRADICTED' end,
  case when signal = 'BREAKDOWN' then 'UPSTREAM_BREAKDOWN' end, case when action = 'ADD' and losing and new_confirmation is null then 'AVERAGING_DOWN_WITHOUT_SIGNAL' end], lambda x: x is not null)"""
_soft = """list_filter([case when profile = 'EVENT' and sector_1d > 0 and stock_1d <= 0 then 'RELATIVE_WEAKNESS' end, case when profile <> 'POSITION' and confirmed is not true then 'NO_PRICE_CONFIRMATION' end,
  case when fomo >= 8 then 'EXTREME_FOMO' end, case when profile = 'EVENT' and priced_in then 'EXPECTATION_ALREADY_PRICED' end], lambda x: x is not null)"""
_judged = f"(select *, case when len(hard) > 0 then 'NO_TRADE' when len(missing) > 0 or len(soft) > 0 then 'WAIT' when score >= 80 then 'PASS' when score >= 70 then 'WAIT' else 'NO_TRADE' end as decision from (select *, {_scored(decisions.PROFILES)} as score, {_absent} as missing, {_hard} as hard, {_soft} as soft from {_given}))"


#: The same in doubles: decimals of 20 columns a row cost more than all rules.
_double = lambda n: _ratio(n).replace("0.7 ", "0.7D ").replace("20.0", "20.0D").replace("-0.5", "-0.5D")


def _evaluated(d: Day) -> DataFrame:
    rows = d.line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.expr(text).alias(c) for c, text in _context.items()], *[F.expr(_double(n)).cast("double").alias(c) for n, c in enumerate(_names)])
    return decisions.evaluate(rows)


@register("m7_dimension_scores", f"select id, profile, score, array_to_string(missing, ',') as missing from {_judged}")
def _(d: Day):
    return _evaluated(d).select("id", "profile", "score", F.array_join("missing", ",").alias("missing"))


@register("m8_veto_rules", f"select profile, array_to_string(hard, ',') as hard, array_to_string(soft, ',') as conditional, count(*) as n from {_judged} group by 1, 2, 3")
def _(d: Day):
    names = [F.array_join(c, ",").alias(c) for c in ("hard", "conditional")]
    return _evaluated(d).groupBy("profile", *names).agg(F.count("*").alias("n"))


@register("m9_decision", f"select id, decision, case when decision <> 'WAIT' then '' when len(missing) + len(soft) = 0 then 'market conditions change' else array_to_string(list_transform(missing, lambda x: 'complete ' || x) || list_transform(soft, lambda x: 'lift ' || x), ',') end as triggers from {_judged}")
def _(d: Day):
    return _evaluated(d).select("id", "decision", F.array_join("triggers", ",").alias("triggers"))


#: Other weights to replay by; a dimension that is not named keeps its own.
_other = {"EVENT": {"catalyst_quality": 35.0, "expectation_gap": 5.0}, "SWING": {"stock_trend": 30.0, "key_level": 10.0}}
_again = {p: ws | _other.get(p, {}) for p, ws in decisions.PROFILES.items()}


@register("m10_replay_weights", f"select id, score, decision, case when decision = 'WAIT' and was <> 'WAIT' then 'verify the stored evidence again' when was = 'WAIT' then 'kept' else '' end as trigger from (select id, was, score, case when len(hard) > 0 or score < 70 then 'NO_TRADE' when len(soft) > 0 or len(missing) > 0 or score < 80 then 'WAIT' else 'PASS' end as decision from (select * exclude (score, decision), decision as was, {_scored(_again)} as score from {_judged}))")
def _(d: Day):
    stored = _evaluated(d).select("id", "profile", "dimensions", "missing", "hard", "conditional", "triggers", F.col("decision").alias("was"))
    trigger = F.when(F.col("was") == "WAIT", "kept").otherwise(F.array_join("triggers", ","))
    return decisions.replay(stored, _other).select("id", "score", "decision", trigger.alias("trigger"))


@register("m3_confident_ratio", f"select id, round(d / 10.0 * (0.5 + 0.5 * t / 8.0), 6) as ratio from {_intent}")
def _(d: Day):
    return _intents(d).select("id", F.round(decisions.confident(F.col("d") / F.lit(10), F.col("t") / F.lit(8)), 6).alias("ratio"))


@register("m11_discipline", "select e.overridden, count(*) as n, count(r.pnl) as reviewed, count(*) filter (r.pnl > 0) as wins, round(count(*) filter (r.pnl > 0) / count(r.pnl), 6) as win_rate, round(cast(sum(cast(r.pnl as decimal(24,4))) as double) / count(r.pnl), 4) as mean_pnl from (select o_orderkey as execution_id, o_orderstatus = 'F' as overridden from orders) e left join (select l_orderkey as execution_id, round(sum(cents * (d - 5)) / 10000.0, 2) as pnl from line where l_orderkey % 3 = 0 group by l_orderkey) r using (execution_id) group by e.overridden")
def _(d: Day):
    done = d.view("orders").select(F.col("o_orderkey").alias("execution_id"), (F.col("o_orderstatus") == "F").alias("overridden"))
    reviews = d.view("line").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("execution_id")).agg(F.round(F.sum(F.col("cents") * (F.col("d") - 5)).cast("double") / 10000, 2).alias("pnl"))
    out = decisions.discipline(done, reviews)
    return out.withColumn("win_rate", F.round("win_rate", 6)).withColumn("mean_pnl", F.round("mean_pnl", 4))


# lifecycle


def _events(d: Day) -> DataFrame:
    return d.view("events").select(F.col("user_id").alias("entity"), "event_id", "ts", F.col("event_type").alias("state"))


_place = lambda c: f"coalesce(list_position(['signup', 'view', 'click', 'purchase'], {c}), 0)"


_step = lambda n, state: f"(select e.*, min(case when state = '{state}'" + (f" and o > a{n - 1}.o and ts >= a{n - 1}.ts" if n else "") + f" then struct_pack(o := o, ts := ts) end) over (partition by entity) as a{n} from {_step(n - 1, _path[n - 1]) if n else '(select user_id as entity, event_id as o, ts, event_type as state from events)'} e)"
_path = ("signup", "view", "click", "purchase")
#: The state held before each event and the time of its last change.
_held = f"(select *, case when a3.o < o then 4 when a2.o < o then 3 when a1.o < o then 2 when a0.o < o then 1 else 0 end as k from {_step(3, 'purchase')})"


@register("n1_transition_validation", f"""select o as event_id, ['signup', 'view', 'click', 'purchase'][k] as held, case when ts < [a0, a1, a2, a3][k].ts then 'BACKWARDS' when state = 'error' then 'RESERVED' when k = 4 then 'AT_END'
    when state = ['signup', 'view', 'click', 'purchase'][k + 1] then 'ACCEPTED' when k = 0 then 'NOT_FIRST' else 'NOT_NEXT' end as verdict from {_held}""")
def _(d: Day):
    return lifecycle.transitions(_events(d)).select("event_id", "held", "verdict")


@register("n2_state_fold", f"select user_id as entity, ['signup', 'view', 'click', 'purchase'][list_reduce(list_prepend(cast(0 as bigint), list(cast({_place('event_type')} as bigint) order by ts, event_id)), lambda s, x: case when x = s + 1 then x else s end)] as state from events group by user_id")
def _(d: Day):
    return lifecycle.fold_states(_events(d)).select("entity", "state")


_log = "(select o_orderkey as run_id, cast(o_orderdate as date) as day, case o_orderkey % 5 when 0 then 'FAILED' when 1 then 'BLOCKED' when 2 then 'RUNNING' else 'SUCCESS' end as status, case when o_orderkey % 5 = 2 and o_orderkey % 7 <> 0 then null else o_orderdate end as finished_at, case when o_orderkey % 5 in (0, 1) and o_orderkey % 11 <> 0 then 'e' end as error from orders)"


def _runs(d: Day) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "FAILED").when(k % 5 == 1, "BLOCKED").when(k % 5 == 2, "RUNNING").otherwise("SUCCESS")
    return d.view("orders").select(k.alias("run_id"), F.col("o_orderdate").cast("date").alias("day"), status.alias("status"), F.when(~((k % 5 == 2) & (k % 7 != 0)), F.col("o_orderdate")).alias("finished_at"), F.when((k % 5).isin(0, 1) & (k % 11 != 0), "e").alias("error"))


@register("n3_run_log_invariants", f"select rule, count(*) as n from (select unnest(list_filter([case when (finished_at is not null) <> (status in ('SUCCESS', 'FAILED', 'BLOCKED')) then 'FINISHED' end, case when (error is not null) <> (status in ('FAILED', 'BLOCKED')) then 'ERROR' end], lambda x: x is not null)) as rule from {_log}) group by rule")
def _(d: Day):
    return lifecycle.run_violations(_runs(d)).groupBy("rule").agg(F.count("*").alias("n"))


@register("n4_stage_roll_up", f"select day, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'BLOCKED') as blocked, bool_and(status = 'SUCCESS') as complete from {_log} group by day")
def _(d: Day):
    return lifecycle.roll_up(_runs(d))


@register("a20_run_log_upsert", f"select run_id, case when run_id % 4 = 0 then 'RETRIED' else status end as status from {_log}")
def _(d: Day):
    log = _runs(d).select("run_id", "status")
    return landing.merge(log, log.where("run_id % 4 = 0").withColumn("status", F.lit("RETRIED")), ["run_id"])


@register("p1_trading_days", "select cast(x as date) as day from range(date '1995-01-01', date '2001-12-31', interval 1 day) t(x) where isodow(x) < 6 and cast(x as date) in (select trade_date from bars)")
def _(d: Day):
    return lifecycle.calendar(d.spark, "1995-01-01", "2001-12-30").join(d.view("bars").select(F.col("trade_date").alias("day")).distinct(), "day", "left_semi")


@register("p2_nearest_trading_days", "select d.day, max(t.day) filter (t.day <= d.day) as latest, min(t.day) filter (t.day > d.day) as following from (select distinct trade_date as day from bars) d join (select cast(x as date) as day from range(date '1994-12-01', date '2002-02-01', interval 1 day) r(x) where isodow(x) < 6) t on t.day between d.day - 60 and d.day + 60 group by d.day")
def _(d: Day):
    return lifecycle.nearest_days(d.view("bars").select(F.col("trade_date").alias("day")), lifecycle.calendar(d.spark, "1994-12-01", "2002-01-31"))


# validation of stored results


@register("o1_record_checks", """select 'SCORE_RANGE' as rule, count(*) filter (score < 0 or score > 100) as n from res union all select 'PERCENTILE_RANGE', count(*) filter (rank_percentile < 0 or rank_percentile > 1) from res
  union all select 'MARGIN_RANGE', count(*) from panel where factor = 'gross_margin' and status = 'VALUE' and (raw_value < 0 or raw_value > 40) union all select 'MISSING_KEY', count(*) filter (score is null) from res
  union all select 'EMPTY_VERSION', count(*) filter (trim(coalesce(o_orderpriority, '')) = '') from orders union all select 'LATE', count(*) from observations where announce_date > date '2001-06-30' union all select 'UNKNOWN_FACTOR', count(*) from panel where factor not in (select factor from weights)""")
def _(d: Day):
    margins = d.panel.where("factor = 'gross_margin' and status = 'VALUE'")
    found = {
        "SCORE_RANGE": validate.outside(d.results, "score", 0.0, 100.0, "SCORE_RANGE"),
        "PERCENTILE_RANGE": validate.outside(d.results, "rank_percentile", 0.0, 1.0, "PERCENTILE_RANGE"),
        "MARGIN_RANGE": validate.outside(margins, "raw_value", 0.0, 40.0, "MARGIN_RANGE"),
        "MISSING_KEY": validate.without(d.results, ["strategy", "entity", "score"], "MISSING_KEY"),
        "EMPTY_VERSION": validate.blank(d.view("orders"), "o_orderpriority", "EMPTY_VERSION"),
        "LATE": validate.late(testbed.observations(d.spark, d.sf_dir), "announce_date", d.as_of, "LATE"),
        "UNKNOWN_FACTOR": validate.unknown(d.panel, "factor", d.weights.select("factor"), "UNKNOWN_FACTOR"),
    }
    return validate.counted(reduce(DataFrame.unionByName, [f.select("rule") for f in found.values()]), list(found))


@register("o2_cross_references", "select count(*) as n from weights w join res r using (strategy) left join inside p on p.entity = r.entity and p.factor = w.factor where r.eligible and p.factor is null")
def _(d: Day):
    cited = d.results.where("eligible").select("strategy", "entity").join(F.broadcast(d.weights.select("strategy", "factor")), "strategy")
    return validate.dangling(cited, d.panel, ["entity", "factor"]).agg(F.count("*").alias("n"))


@register("o3_candidate_semantics", """select 'CAP' as rule, cast(count(*) > 6 as bigint) as n from (select entity from chosen union all select entity from ca) union all select 'DUPLICATE', count(*) from chosen union all select 'VETOED', (select count(*) from ca) - (select count(*) from live)
  union all select 'PRIMARY', count(*) from ca where entity % 2 = 0 and not exists (select 1 from qual q where q.entity = ca.entity and q.qualified and q.strategy = 'momentum')""")
def _(d: Day):
    # the day's candidates, and beside them all that might have been, half of these under another strategy
    names = ["entity", "primary_strategy", "validation", "signal"]
    other = d.assembled.withColumn("primary_strategy", F.when(F.col("entity") % 2 == 0, "momentum").otherwise(F.col("primary_strategy")))
    return validate.candidate_findings(d.candidates.select(*names).unionByName(other.select(*names)), d.qualified, 6)


@register("o4_regime_checks", "select cast(1 as bigint) as n, true as known from br")
def _(d: Day):
    known = F.col("regime").isin("BULL", "RANGE_UP", "RANGE", "RANGE_DOWN", "BEAR")
    return d.regime.agg(F.count("*").alias("n"), F.bool_and(known).alias("known"))


@register("o5_evidence_availability", "select count(*) as n from lo where known > date '2001-06-30'")
def _(d: Day):
    from lodestar.operators import factors
    from lodestar.plans import testbed

    refs = factors.evidence(testbed.observations(d.spark, d.sf_dir), d.as_of).select(F.explode("refs").alias("r"))
    return refs.where("r.period is not null").agg(F.count_if(F.col("r.known") > F.lit(d.as_of).cast("date")).alias("n"))
