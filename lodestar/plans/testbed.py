"""The driver's tables seen as the domain's: bars, entities, statements, valuations, events.

VIEWS holds, in order of use, SQL that Spark and DuckDB both run.  Amounts are
whole cents and prices whole ten-thousandths until the last step, so that sums
do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-06-30"

VIEWS = {
    "line": """
        select l_suppkey as entity, cast(l_shipdate as date) as trade_date, l_orderkey, l_linenumber,
          cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_discount * 100) as bigint) as d, cast(round(l_tax * 100) as bigint) as t,
          cast(l_quantity as bigint) as qty, l_returnflag as flag
        from lineitem""",
    "priced": """
        select *, cast(floor(cast((100 + d) * (100 + t) * (40000000 + cents) as double) / 400000) as bigint) as p4 from line""",
    "bars": """
        select entity, trade_date, cast(min_by(p4, (l_orderkey, l_linenumber, cents)) as double) / 10000 as open, cast(max(p4) as double) / 10000 as high,
          cast(min(p4) as double) / 10000 as low, cast(max_by(p4, (l_orderkey, l_linenumber, cents)) as double) / 10000 as close,
          cast(sum(qty) as double) as volume, cast(sum(cents) as double) / 100 as amount
        from priced group by entity, trade_date""",
    "benchmark_bars": """
        select trade_date, cast(sum(cast(round(close * 10000) as bigint)) as double) / count(*) / 10000 as close
        from bars group by trade_date""",
    "securities": """
        select s_suppkey as entity, s_name as name, r_name as exchange, f.list_date, s_acctbal < 0 as is_st, s_suppkey % 37 = 0 as is_delisting, cast(null as int) as suspended_days
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
          left join (select entity, min(trade_date) as list_date from bars group by entity) f on f.entity = s_suppkey""",
    "industry": """
        select s_suppkey as entity, n_nationkey as industry_id, n_name as industry_name, cast('1995-01-01' as date) as as_of
        from supplier join nation on s_nationkey = n_nationkey""",
    "quarters": """
        select entity, last_day(make_date(year(trade_date), quarter(trade_date) * 3, 1)) as report_period,
          sum(cents * (100 - d)) as revenue, sum(cents * 62) as cost, sum(cents * (26 + t - 2 * d)) as profit, sum(cents * case when flag = 'A' then 40 else 12 end) as ocf,
          sum(cents * d) as debt, sum(cents * (14 - d)) as equity, sum(cents * qty) as inventory, sum(cents * t) as goodwill, sum(case when flag = 'R' then cents * 9 else cents * 4 end) as dividend
        from line group by entity, last_day(make_date(year(trade_date), quarter(trade_date) * 3, 1))""",
    "statements_wide": """
        select entity, report_period, cast(report_period + interval '45' day as date) as announce_date,
          cast(sum(revenue) over w4 as double) / 10000 as revenue_ttm, cast(sum(profit) over w4 as double) / 10000 as net_profit_parent_ttm,
          cast(sum(ocf) over w4 as double) / 10000 as ocf_ttm, cast(debt as double) / 10000 as interest_bearing_debt, cast(equity as double) / 10000 as equity_parent,
          cast(inventory as double) / 10000 as inventory, cast(goodwill as double) / 10000 as goodwill, cast(sum(dividend) over w4 as double) / 10000 as dividend_ttm,
          case when lag(revenue, 4) over w > 0 then (cast(revenue as double) / lag(revenue, 4) over w - 1) * 100 end as revenue_yoy,
          case when lag(profit, 4) over w > 0 then (cast(profit as double) / lag(profit, 4) over w - 1) * 100 end as net_profit_parent_yoy,
          case when lag(revenue, 12) over w > 0 then (cast(revenue as double) / lag(revenue, 12) over w - 1) * 33 end as revenue_cagr_3y,
          case when lag(profit, 12) over w > 0 then (cast(profit as double) / lag(profit, 12) over w - 1) * 33 end as net_profit_parent_cagr_3y,
          case when equity > 0 then cast(profit as double) / equity * 10 end as roe_ttm, case when revenue > 0 then cast(revenue - cost as double) / revenue * 100 end as gross_margin,
          case when debt + equity > 0 then cast(debt as double) / (debt + equity) * 100 end as debt_to_asset,
          case when profit > 0 then cast(dividend as double) / profit end as dividend_paid_ratio
        from quarters
        window w as (partition by entity order by report_period), w4 as (partition by entity order by report_period rows between 3 preceding and current row)""",
    "valuations_wide": """
        select entity, trade_date as valuation_date, (close - 110) * (1 + entity % 5) as pe_ttm, close / 60 + entity % 3 as pb, volume / 40 as ps_ttm,
          (high - low) * (1 + entity % 4) * 3 as pe_percentile, (close - 112) * 2 as pcf_operating_ttm, (open - 108) / 20 as peg
        from bars""",
    "dividends": """
        select entity, trade_date as ex_date, cast(trade_date - interval '20' day as date) as announce_date, case when flag = 'R' then 'plan' else 'implemented' end as status,
          case when t > 2 then cast(trade_date - interval '1' day as date) end as record_date, cast(d as double) as cash_per_10
        from line where d > 0""",
}

#: Columns of the wide views that become metrics.
STATEMENT_METRICS = (
    "revenue_ttm", "net_profit_parent_ttm", "ocf_ttm", "interest_bearing_debt", "equity_parent", "inventory", "goodwill", "dividend_ttm", "revenue_yoy",
    "net_profit_parent_yoy", "revenue_cagr_3y", "net_profit_parent_cagr_3y", "roe_ttm", "gross_margin", "debt_to_asset", "dividend_paid_ratio",
)
VALUATION_METRICS = ("pe_ttm", "pb", "ps_ttm", "pe_percentile", "pcf_operating_ttm", "peg")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _needs(name: str, held: tuple[str, ...] = ()) -> list[str]:
    """Views that name builds on, itself last, without those that are held and what these build on."""
    words = set(VIEWS[name].replace("(", " ").replace(")", " ").split())
    found: list[str] = []
    for other in VIEWS:
        if other in words and other != name and other not in held:
            found += [x for x in _needs(other, held) if x not in found]
    return [*found, name]


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a table of sf_dir. held: views that are there already, which are read in place of their SQL."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    held = held or {}
    chain = _needs(name, tuple(held))
    text = "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in chain) + f" select * from {name}"
    words = set(text.replace("(", " ").replace(")", " ").split())
    read = {t: held[t] if t in held else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (*TABLES, *held) if t in words}
    for t in read:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(text, **read)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in long form: entity, metric, report_period, announce_date, value."""
    from lodestar.operators.normalize import unpivot_metrics

    return unpivot_metrics(view(spark, sf_dir, "statements_wide"), ("entity", "report_period", "announce_date"), STATEMENT_METRICS)


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.operators.normalize import unpivot_metrics

    return unpivot_metrics(view(spark, sf_dir, "valuations_wide"), ("entity", "valuation_date"), VALUATION_METRICS)


def sql_prelude(*extra: tuple[str, str]) -> str:
    """All views, and extra ones, as the WITH clause of DuckDB SQL."""
    long_o = " union all ".join(f"select entity, '{m}' as metric, report_period, announce_date, {m} as value from statements_wide" for m in STATEMENT_METRICS)
    long_v = " union all ".join(f"select entity, '{m}' as metric, valuation_date, {m} as value from valuations_wide" for m in VALUATION_METRICS)
    every = [*VIEWS.items(), ("observations", long_o), ("valuations", long_v), *extra]
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in every) + "\n"
