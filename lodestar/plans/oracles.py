"""The day's stages once more, as DuckDB SQL: what the queries are held against."""

from __future__ import annotations

from lodestar.operators.factors import PASSED, RATIOS, STALE_DAYS, VALUATIONS
from lodestar.operators.qualify import THRESHOLDS
from lodestar.operators.scoring import STRATEGIES
from lodestar.plans import testbed

DAY = f"date '{testbed.AS_OF}'"


def _price() -> str:
    def change(n: int) -> str:
        return f"case when count(close) filter (rn <= {n + 1}) = {n + 1} and max(close) filter (rn = {n + 1}) <> 0 then max(close) filter (rn = 1) / max(close) filter (rn = {n + 1}) - 1 end"

    return f"""select entity, case when count(amount) filter (rn <= 20) = 20 then cast(sum(cast(amount as decimal(18,4))) filter (rn <= 20) as double) / 20 end as avg_amount_20d,
      {change(20)} as ret_20d, {change(60)} as ret_60d,
      case when count(high) filter (rn <= 252) = 252 and max(high) filter (rn <= 252) > 0 then max(close) filter (rn = 1) / max(high) filter (rn <= 252) end as proximity_52w_high
      from tb group by entity"""


def _latest(table: str, period: str, known: str) -> str:
    return f"""select entity, metric, value, {known} as known, {period} as period from (select *, row_number() over (partition by entity, metric
      order by (value is not null) desc, {period} desc, {known} desc) as rn from {table} where {known} <= {DAY}) where rn = 1"""


def _stated(table: str, latest: str, stale: int | None) -> str:
    old = f"when date_diff('day', l.known, {DAY}) > {stale} then 'STALE'" if stale else ""
    return f"""select e.entity, x.metric, l.value, case when r.metric is null then 'NOT_APPLICABLE' when l.metric is null or l.value is null then 'NULL' {old} else 'VALUE' end as status
      from ents e cross join (select distinct metric from {table}) x left join (select distinct entity, metric from {table}) r on r.entity = e.entity and r.metric = x.metric
      left join {latest} l on l.entity = e.entity and l.metric = x.metric"""


def _values(rows) -> str:
    return "values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


def _ratio(name: str, a: str, b: str) -> str:
    status = "case when a.status = 'NOT_APPLICABLE' or b.status = 'NOT_APPLICABLE' then 'NOT_APPLICABLE' when a.status = 'NULL' or b.status = 'NULL' then 'NULL' when a.status = 'STALE' or b.status = 'STALE' then 'STALE' when b.value <= 0 then 'NOT_APPLICABLE' else 'VALUE' end"
    return f"select a.entity, '{name}' as factor, {status} as status, case when {status} = 'VALUE' then a.value / b.value end as raw_value from ms a join ms b on a.entity = b.entity and a.metric = '{a}' and b.metric = '{b}'"


PRICE = ("avg_amount_20d", "ret_20d", "ret_60d", "proximity_52w_high")
_weights = [(s, f, float(w), n) for s, fs in STRATEGIES.items() for n, (f, w) in enumerate(fs)]
_pct = lambda v, keys: f"round((rank() over (partition by {keys} order by {v}) + (count(*) over (partition by {keys}, {v}) - 1) / 2) / count(*) over (partition by {keys}), 12)"

STAGES: tuple[tuple[str, str], ...] = (
    ("tb", f"select *, row_number() over (partition by entity order by trade_date desc) as rn from bars where trade_date <= {DAY}"),
    ("pm", _price()),
    ("price_panel", " union all ".join(f"select entity, '{n}' as factor, case when {n} is null then 'NULL' else 'VALUE' end as status, {n} as raw_value from pm" for n in PRICE)),
    ("ents", "select distinct entity from tb"),
    ("lo", _latest("observations", "report_period", "announce_date")),
    ("ms", _stated("observations", "lo", STALE_DAYS)),
    ("lv", _latest("valuations", "valuation_date", "valuation_date")),
    ("vs", _stated("valuations", "lv", None)),
    ("metric_panel", f"select entity, metric as factor, status, case when status = 'VALUE' then value end as raw_value from ms where metric in ({', '.join(repr(p) for p in PASSED)}) union all " + " union all ".join(_ratio(*r) for r in RATIOS)),
    ("valuation_panel", "select entity, metric as factor, s as status, case when s = 'VALUE' then value end as raw_value from (select *, case when status = 'VALUE' and value <= 0 and metric in ("
        + ", ".join(repr(n) for n, p in VALUATIONS if p) + ") then 'NOT_APPLICABLE' else status end as s from vs)"),
    ("dy", f"""select t.entity, 'dividend_yield_ttm' as factor, case when c.entity is null then 'NOT_APPLICABLE' when t.close <= 0 then 'NULL' else 'VALUE' end as status, c.cash / 10 / t.close * 100 as raw_value
        from (select entity, close from tb where rn = 1) t left join (select entity, coalesce(sum(cash_per_10) filter (status = 'implemented' and announce_date <= {DAY} and ex_date >= {DAY} - 365 and ex_date <= {DAY} and cash_per_10 > 0), 0) as cash
        from dividends group by entity) c on c.entity = t.entity"""),
    ("panel", "select * from price_panel union all select * from metric_panel union all select * from valuation_panel union all select * from dy"),
    ("weights", f"select * from ({_values(_weights)}) w(strategy, factor, weight, pos)"),
    ("uni", f"""select s.entity, list_filter([case when exchange not in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') then 'EXCHANGE' end, case when is_st then 'ST' end, case when is_delisting then 'DELISTING' end,
          case when suspended_days > 30 then 'SUSPENDED' end, case when date_diff('day', list_date, {DAY}) < 365 then 'LISTING_AGE' end,
          case when m.entity is null then 'NO_MARKET_DATA' end, case when p.status = 'VALUE' and p.raw_value < 50000 then 'LOW_LIQUIDITY' end,
          case when p.status is distinct from 'VALUE' then 'NO_LIQUIDITY_MEASURE' end], lambda x: x is not null) as failed
        from securities s left join (select distinct entity from bars where trade_date = (select max(trade_date) from tb)) m on m.entity = s.entity
          left join price_panel p on p.entity = s.entity and p.factor = 'avg_amount_20d'"""),
    ("members", "select entity from uni where len(failed) = 0"),
    ("inside", "select p.* from panel p join members using (entity)"),
    ("el", """select i.entity, w.strategy, bool_and(coalesce(p.status = 'VALUE', false)) as eligible, string_agg(w.factor || ': ' || coalesce(p.status, 'MISSING'), ',' order by w.pos) filter (coalesce(p.status, '') <> 'VALUE') as reasons
        from (select distinct entity from inside) i cross join weights w left join inside p on p.entity = i.entity and p.factor = w.factor group by i.entity, w.strategy"""),
    ("sv", f"""select w.strategy, p.entity, w.factor, w.weight, w.pos, {_pct('p.raw_value * sign(w.weight)', 'w.strategy, w.factor')} as pct
        from inside p join weights w on w.factor = p.factor join el on el.entity = p.entity and el.strategy = w.strategy and el.eligible"""),
    ("bl", "select strategy, entity, cast(sum(cast(abs(weight) as decimal(18,6)) * cast(pct as decimal(18,12))) as double) / sum(abs(weight)) as blend from sv group by strategy, entity"),
    ("sc", f"select strategy, entity, round(blend, 12) as blend, round(blend * 100, 9) as score, case when count(*) over (partition by strategy) > 1 then {_pct('blend', 'strategy')} end as rank_percentile, count(*) over (partition by strategy) as n from bl"),
    ("res", "select el.*, sc.score, sc.rank_percentile, sc.blend from el left join sc using (strategy, entity)"),
    ("lim", f"select * from ({_values([(*t, n) for n, t in enumerate(THRESHOLDS)])}) l(strategy, factor, low, high, pos)"),
    ("ab", """select r.strategy, r.entity, bool_and(ok) as absolute_pass, string_agg(factor || why, ',' order by pos) filter (not ok) as risks from (
          select r.strategy, r.entity, l.factor, l.pos, coalesce(p.status = 'VALUE' and (l.low is null or p.raw_value >= l.low) and (l.high is null or p.raw_value <= l.high), false) as ok,
            case when coalesce(p.status, '') = 'VALUE' then ':limit' else ':missing' end as why
          from res r join lim l on l.strategy = r.strategy left join panel p on p.entity = r.entity and p.factor = l.factor where r.rank_percentile is not null) r group by r.strategy, r.entity"""),
    ("qual", "select r.strategy, r.entity, r.rank_percentile, r.rank_percentile >= 0.75 as percentile_pass, ab.absolute_pass, r.rank_percentile >= 0.75 and ab.absolute_pass as qualified, ab.risks from res r join ab using (strategy, entity) where r.rank_percentile is not null"),
    ("prim", "select entity, strategy from (select *, row_number() over (partition by entity order by rank_percentile desc, strategy) as k from qual where qualified) where k = 1"),
    ("br", """select count(*) filter (last > mean) / count(*) as breadth, count(*) as entities from (select entity, count(close) as k, max(close) filter (rn = 1) as last,
        cast(sum(cast(close as decimal(18,4))) as double) / count(close) as mean from tb where rn <= 20 group by entity) where k = 20"""),
    ("bb", f"select round(close, 4) as close, row_number() over (order by trade_date desc) as rn from benchmark_bars where close > 0 and trade_date <= {DAY}"),
    ("be", """select case when count(*) >= 60 then max(close) filter (rn = 1) / max(close) filter (rn = 60) - 1 end as ret,
        case when count(*) >= 60 then (cast(sum(cast(close as decimal(18,4))) filter (rn <= 20) as double) / 20) / (cast(sum(cast(close as decimal(18,4))) filter (rn <= 60) as double) / 60) end as trend,
        case when count(*) >= 60 then max(close) filter (rn = 1) / max(close) filter (rn = 21) - 1 end as ret_short from bb"""),
    ("vr", f"""select entity, case when count(*) >= 20 then (cast(sum(cast(volume as decimal(18,4))) filter (rn <= 5) as double) / 5) / (cast(sum(cast(volume as decimal(18,4))) as double) / 20) end as volume_ratio
        from (select *, row_number() over (partition by entity order by trade_date desc) as rn from bars where trade_date <= {DAY} and volume > 0) where rn <= 20 group by entity"""),
    ("ix", """select i.industry_id, count(*) as members, round(cast(sum(cast(round(p.raw_value, 9) as decimal(24,9))) as double) / count(*) - max(be.ret_short), 9) as excess
        from industry i join panel p on p.entity = i.entity and p.factor = 'ret_20d' and p.status = 'VALUE' cross join be group by i.industry_id"""),
    ("wide", "select entity, " + ", ".join(f"max(raw_value) filter (factor = '{f}' and status = 'VALUE') as {f}" for f in (*PRICE, "dividend_yield_ttm")) + " from panel group by entity"),
    ("ev", """select w.*, vr.volume_ratio, round(w.ret_60d - be.ret, 9) as relative_strength, ix.excess as industry_excess
        from wide w cross join be left join vr using (entity) left join industry i using (entity) left join ix using (industry_id)"""),
    ("va", """select *, case when veto or bad >= 2 then 'CONTRADICTED' when up and bad = 0 then 'CONFIRMED' else 'NEUTRAL' end as validation from (
          select *, cast(avg_amount_20d >= 60000 as int) + cast(up as int) + cast(industry_excess > 0 as int) + cast(relative_strength > 0 as int) + cast(volume_ratio > 1.05 as int) as good,
            cast(veto as int) + cast(down as int) + cast(industry_excess < -0.05 as int) + cast(relative_strength < -0.15 as int) + cast(volume_ratio < 0.7 as int) as bad from (
          select ev.*, p.strategy, avg_amount_20d < 52000 as veto, case when p.strategy = 'momentum' then ret_20d > 0.064 and proximity_52w_high > 0.85 else ret_20d > 0 end as up,
            case when p.strategy = 'momentum' then not (ret_20d > 0.064 and proximity_52w_high > 0.85) and (ret_20d < 0 or proximity_52w_high < 0.8) else ret_20d < -0.15 end as down
          from prim p join ev using (entity)))"""),
    ("sg", """select *, case when ret_20d < -0.15 then 'BREAKDOWN' when ret_60d > 0.15 and ret_20d < -0.05 then 'TREND_WEAKEN'
          when strategy = 'momentum' and proximity_52w_high >= 0.95 then 'BREAKOUT' when strategy = 'momentum' and ret_60d >= 0.2 and ret_20d between 0 and 0.05 then 'PULLBACK'
          when strategy = 'momentum' and ret_20d >= 0.064 and proximity_52w_high >= 0.85 and proximity_52w_high < 0.95 then 'TREND_CONTINUE'
          when strategy in ('value', 'dividend') and dividend_yield_ttm >= 3 and ret_20d > -0.05 then 'DIVIDEND_SUPPORT'
          when strategy in ('value', 'dividend') and ret_20d between -0.05 and 0.02 then 'VALUE_CONTRARIAN' else 'NO_SIGNAL' end as signal from va"""),
    ("ca", "select sg.entity, sg.strategy as primary_strategy, validation, signal, best, n_qualified, strategies from sg join (select entity, max(rank_percentile) as best, count(*) as n_qualified, string_agg(strategy, ',' order by strategy) as strategies from qual where qualified group by entity) using (entity)"),
    ("live", "select * from ca where validation <> 'CONTRADICTED' and signal <> 'BREAKDOWN'"),
    ("rv", "select distinct entity from (select q.entity, row_number() over (partition by q.strategy order by q.rank_percentile desc, q.entity) as k from qual q join live using (entity) where q.qualified) where k <= 2"),
    ("pick", """select * from (select live.*, rv.entity is not null as held, row_number() over (partition by rv.entity is not null order by best desc, n_qualified desc, validation = 'CONFIRMED' desc, entity) as k,
        (select count(*) from rv) as n_held from live left join rv using (entity)) where held or k <= 12 - n_held"""),
    ("chosen", "select *, row_number() over (order by best desc, n_qualified desc, validation = 'CONFIRMED' desc, entity) as position from pick"),
)


def sql(select: str) -> str:
    """select over the views and all stages."""
    return testbed.sql_prelude(*STAGES) + select
