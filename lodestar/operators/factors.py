"""Factors: trailing price windows, as-of observations, ratios, valuations, dividend yield.

Each operator gives the long panel entity, factor, status, raw_value.  A status
other than VALUE carries no number.  Windows count bars present and are never
shortened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import NOT_APPLICABLE, NULL, STALE, VALUE, exact_sum, visible
from lodestar.operators.normalize import available_at

#: Windows in bars, and freshness in days.
AMOUNT_WINDOW, SHORT_RETURN, LONG_RETURN, YEAR = 20, 20, 60, 252
STALE_DAYS = 400

#: Metrics that are factors as they are.
PASSED = ("revenue_yoy", "net_profit_parent_yoy", "revenue_cagr_3y", "net_profit_parent_cagr_3y", "roe_ttm", "gross_margin", "debt_to_asset", "dividend_paid_ratio")
#: Factor, numerator, denominator.
RATIOS = (
    ("ocf_to_net_profit", "ocf_ttm", "net_profit_parent_ttm"),
    ("interest_bearing_debt_to_equity", "interest_bearing_debt", "equity_parent"),
    ("goodwill_to_equity", "goodwill", "equity_parent"),
    ("dividend_payout_ttm", "dividend_ttm", "net_profit_parent_ttm"),
    ("revenue_ttm_to_inventory", "revenue_ttm", "inventory"),
)
#: Valuation factor and whether only positive values count.
VALUATIONS = (("pe_ttm", True), ("pb", True), ("ps_ttm", True), ("pe_percentile", False), ("pcf_operating_ttm", True), ("peg", True))

#: Of each factor its unit (amount, x for ratios, %), and the evidence it is made of.
UNITS = dict.fromkeys(("ret_20d", "ret_60d", "proximity_52w_high", *(n for n, _, _ in RATIOS), *(n for n, _ in VALUATIONS)), "x") | dict.fromkeys((*PASSED, "pe_percentile", "dividend_yield_ttm"), "%") | {"avg_amount_20d": "amount"}
INPUTS = (
    {"avg_amount_20d": ("amount",), "ret_20d": ("close",), "ret_60d": ("close",), "proximity_52w_high": ("close", "high"), "dividend_yield_ttm": ("cash_per_10", "close")}
    | {m: (m,) for m in (*PASSED, *(n for n, _ in VALUATIONS))} | {n: (a, b) for n, a, b in RATIOS}
)
VERSION = "1"


def trailing(bars: DataFrame, as_of: str, most: int) -> DataFrame:
    """The last most bars of each entity at as_of, rn counting back from 1."""
    order = Window.partitionBy("entity").orderBy(F.desc("trade_date"))
    return visible(bars, as_of, "trade_date").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def _status(value: Column) -> list[Column]:
    return [F.when(value.isNull(), NULL).otherwise(VALUE).alias("status"), value.alias("raw_value")]


def _full(column: str, n: int) -> Column:
    """Whether the last n bars are there and all have column."""
    return F.count_if((F.col("rn") <= n) & F.col(column).isNotNull()) == n


def price_measures(bars: DataFrame, as_of: str, *, amount: int = AMOUNT_WINDOW, short: int = SHORT_RETURN, long: int = LONG_RETURN, year: int = YEAR) -> DataFrame:
    """entity and one column for each price factor, null where its window is not full: one pass over the last bars."""
    at = lambda n: F.max(F.when(F.col("rn") == n, F.col("close")))
    last = at(1)

    def change(n: int) -> Column:
        return F.when(_full("close", n + 1) & (at(n + 1) != 0), last / at(n + 1) - 1)

    peak = F.max(F.when(F.col("rn") <= year, F.col("high")))
    return trailing(bars, as_of, max(amount, long + 1, year)).groupBy("entity").agg(
        F.when(_full("amount", amount), exact_sum(F.when(F.col("rn") <= amount, F.col("amount"))) / amount).alias("avg_amount_20d"),
        change(short).alias("ret_20d"),
        change(long).alias("ret_60d"),
        F.when(_full("high", year) & (peak > 0) & last.isNotNull(), last / peak).alias("proximity_52w_high"),
    )


def price_factors(bars: DataFrame, as_of: str) -> DataFrame:
    names = ["avg_amount_20d", "ret_20d", "ret_60d", "proximity_52w_high"]
    long = price_measures(bars, as_of).unpivot("entity", names, "factor", "v")
    return long.select("entity", "factor", *_status(F.col("v")))


def panel_returns(bars: DataFrame, n: int = SHORT_RETURN) -> DataFrame:
    """entity, trade_date, ret at every bar: the same window for all dates in one job."""
    order = Window.partitionBy("entity").orderBy("trade_date")
    start, full = F.lag("close", n).over(order), F.count("close").over(order.rowsBetween(-n, 0))
    return bars.select("entity", "trade_date", F.when((full == n + 1) & (start != 0), F.col("close") / start - 1).alias("ret"))


#: Days from here on are positive in years 1 to 9999, and below 2 to the power of _BITS.
_DAY_ZERO, _BITS = 800_000, 24


def _newest(rows: DataFrame, keys: list[str], columns: list[str], as_of: str, period: str, known: str) -> DataFrame:
    """keys, a struct (value, period, known) for each of columns, and seen: of each column the newest visible row, one with a value if there is any.

    The as-of join of the engine: max_by over an order that is one number, so that rows
    are combined before the shuffle by hash, without a sort of all rows.
    """
    is_seen = F.col(known) <= F.lit(as_of).cast("date")
    place = lambda c: F.coalesce(F.unix_date(F.col(c).cast("date")) + _DAY_ZERO, F.lit(0)).cast("long")
    day = lambda n: F.date_from_unix_date((F.nullif(n.bitwiseAND((1 << _BITS) - 1), F.lit(0)) - _DAY_ZERO).cast("int"))
    dated = rows.withColumns({"_seen": is_seen, "_day": F.shiftleft(place(period), _BITS) + place(known)})
    order = lambda c: F.when(F.col("_seen"), F.col("_day") + F.when(F.col(c).isNotNull(), 1 << (2 * _BITS)).otherwise(0))
    parts = [x for n, c in enumerate(columns) for x in (F.max_by(c, order(c)).alias(f"_v{n}"), F.max(order(c)).alias(f"_o{n}"))]
    best = dated.groupBy(*keys).agg(F.coalesce(F.max("_seen"), F.lit(False)).alias("seen"), *parts)
    told = lambda n: F.struct(F.col(f"_v{n}").alias("value"), day(F.shiftright(f"_o{n}", _BITS)).alias("period"), day(F.col(f"_o{n}")).alias("known"))
    return best.select(*keys, *[F.when(F.col(f"_o{n}").isNotNull(), told(n)).alias(c) for n, c in enumerate(columns)], "seen")


def asof_latest(rows: DataFrame, as_of: str, *, period: str = "report_period", known: str = "announce_date", metrics: list[str] | None = None) -> DataFrame:
    """entity, metric, value, period, known, seen of the newest visible row of each entity and metric, one with a value if there is any.

    Metrics that only later rows report come with period null, and seen false.
    rows are long, or wide with a column for each of metrics; wide ones become
    long only when they are one for each entity.
    """
    if metrics is None:
        return _newest(rows, ["entity", "metric"], ["value"], as_of, period, known).select("entity", "metric", "value.value", "value.period", "value.known", "seen")
    item = lambda m: F.struct(F.lit(m).alias("metric"), F.col(f"{m}.value").alias("value"), F.col(f"{m}.period").alias("period"), F.col(f"{m}.known").alias("known"), F.col("seen"))
    return _newest(rows, ["entity"], list(metrics), as_of, period, known).select("entity", F.inline(F.array(*[item(m) for m in metrics])))


def status_of(asof: str, value: Column, known: Column, reported: Column, seen: Column, stale_days: int | None) -> Column:
    """NOT_APPLICABLE if never reported, NULL if not visible or without a value, STALE if too old, else VALUE."""
    old = F.lit(False) if stale_days is None else F.datediff(F.lit(asof).cast("date"), known) > stale_days
    return F.when(reported.isNull(), NOT_APPLICABLE).when(~seen, NULL).when(value.isNull(), NULL).when(old, STALE).otherwise(VALUE)


def _wide(rows: DataFrame, entities: DataFrame, as_of: str, metrics: list[str], **dates: str) -> DataFrame:
    """A row for each entity with a struct of each metric. rows are long (entity, metric, value), or wide with columns of metrics."""
    item = lambda c: F.struct(F.col(f"{c}value").alias("value"), F.col(f"{c}known").alias("known"), F.col("seen"), F.lit(True).alias("reported"))
    if "metric" in rows.columns:
        latest = asof_latest(rows, as_of, **dates)
        wide = latest.where(F.col("metric").isin(*metrics)).groupBy("entity").pivot("metric", metrics).agg(F.first(item("")))
    else:
        there = [m for m in metrics if m in rows.columns]
        newest = _newest(rows, ["entity"], there, as_of, dates.get("period", "report_period"), dates.get("known", "announce_date"))
        never = F.lit(None).cast("struct<value: double, known: date, seen: boolean, reported: boolean>")
        wide = newest.select("entity", *[(item(f"{m}.") if m in there else never).alias(m) for m in metrics])
    return entities.join(wide, "entity", "left")


def metric_factors(observations: DataFrame, entities: DataFrame, as_of: str, stale_days: int | None = STALE_DAYS) -> DataFrame:
    """The passed-through metrics and the ratios; a denominator of 0 or less makes a ratio NOT_APPLICABLE."""
    metrics = sorted({*PASSED, *(m for _, a, b in RATIOS for m in (a, b))})
    wide = _wide(observations, entities, as_of, metrics)

    def one(m: str) -> Column:
        return status_of(as_of, F.col(f"{m}.value"), F.col(f"{m}.known"), F.col(f"{m}.reported"), F.coalesce(F.col(f"{m}.seen"), F.lit(False)), stale_days)

    items = [F.struct(F.lit(m).alias("factor"), one(m).alias("status"), F.when(one(m) == VALUE, F.col(f"{m}.value")).alias("raw_value")) for m in PASSED]
    for name, a, b in RATIOS:
        x, y = one(a), one(b)
        # the worse of both decides, in the order of the chain
        both = reduce(lambda chain, s: chain.when((x == s) | (y == s), s), (NULL, STALE), F.when((x == NOT_APPLICABLE) | (y == NOT_APPLICABLE), NOT_APPLICABLE))
        status = both.when(F.col(f"{b}.value") <= 0, NOT_APPLICABLE).otherwise(VALUE)
        items.append(F.struct(F.lit(name).alias("factor"), status.alias("status"), F.when(status == VALUE, F.try_divide(F.col(f"{a}.value"), F.col(f"{b}.value"))).alias("raw_value")))
    return wide.select("entity", F.inline(F.array(*items)))


def valuation_factors(valuations: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    """The newest visible multiple of each kind; those that must be positive are NOT_APPLICABLE at 0 or less."""
    names = [n for n, _ in VALUATIONS]
    wide = _wide(valuations, entities, as_of, names, period="valuation_date", known="valuation_date")
    items = []
    for n, positive in VALUATIONS:
        base = status_of(as_of, F.col(f"{n}.value"), F.col(f"{n}.known"), F.col(f"{n}.reported"), F.coalesce(F.col(f"{n}.seen"), F.lit(False)), None)
        status = F.when((base == VALUE) & (F.col(f"{n}.value") <= 0), NOT_APPLICABLE).otherwise(base) if positive else base
        items.append(F.struct(F.lit(n).alias("factor"), status.alias("status"), F.when(status == VALUE, F.col(f"{n}.value")).alias("raw_value")))
    return wide.select("entity", F.inline(F.array(*items)))


def dividend_yield(dividends: DataFrame, bars: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Cash of a year over the last close, in percent.

    No events: NOT_APPLICABLE; no positive close: NULL; none in the year: 0.  The
    year's first day, days before as_of, belongs to it.
    """
    day = F.lit(as_of).cast("date")
    counts = (F.col("status") == "implemented") & (F.col("announce_date") <= day) & (F.col("ex_date") >= F.date_sub(day, days)) & (F.col("ex_date") <= day) & (F.col("cash_per_10") > 0)
    cash = dividends.groupBy("entity").agg(F.coalesce(exact_sum(F.when(counts, F.col("cash_per_10"))), F.lit(0.0)).alias("cash"))
    close = visible(bars, as_of, "trade_date").groupBy("entity").agg(F.max_by("close", "trade_date").alias("close"))
    status = F.when(F.col("cash").isNull(), NOT_APPLICABLE).when(F.col("close").isNull() | (F.col("close") <= 0), NULL).otherwise(VALUE)
    value = F.when(status == VALUE, F.col("cash") / 10 / F.col("close") * 100)
    return close.join(cash, "entity", "left").select("entity", F.lit("dividend_yield_ttm").alias("factor"), status.alias("status"), value.alias("raw_value"))


def panel(bars: DataFrame, observations: DataFrame, valuations: DataFrame, dividends: DataFrame, as_of: str, prices: DataFrame | None = None) -> DataFrame:
    """All factors of each entity with a visible bar: as_of, entity, factor, status, raw_value, unit, inputs, factor_version.

    observations and valuations are long or wide; prices, the price factors of bars, are made if they are not given.
    """
    entities = visible(bars, as_of, "trade_date").select("entity").distinct()
    parts = [price_factors(bars, as_of) if prices is None else prices, metric_factors(observations, entities, as_of), valuation_factors(valuations, entities, as_of), dividend_yield(dividends, bars, as_of)]
    described = F.create_map(*[x for f in UNITS for x in (F.lit(f), F.struct(F.lit(UNITS[f]).alias("unit"), F.array(*[F.lit(i) for i in INPUTS[f]]).alias("inputs")))])
    rows = reduce(DataFrame.unionByName, parts).withColumn("as_of", F.lit(as_of).cast("date")).withColumn("_d", described[F.col("factor")])
    return rows.select("entity", "factor", "status", "raw_value", "as_of", "_d.unit", "_d.inputs", F.lit(VERSION).alias("factor_version"))


def evidence(observations: DataFrame, as_of: str, *, source: str | None = None, units: dict[str, str] | None = None, version: str | None = None) -> DataFrame:
    """entity and refs: the metrics that are cited, ordered, each with period, date, the time from which it was known, value, unit, source and version.

    A metric without a visible row cites nothing: no date, no time, no value.
    """
    latest = asof_latest(observations, as_of)
    unit = reduce(lambda found, u: F.when(F.col("metric") == u[0], u[1]).otherwise(found), (units or {}).items(), F.lit(None).cast("string"))
    told = lambda x: F.lit(x).cast("string")
    item = F.struct("metric", "period", "known", available_at(F.col("known")).alias("known_at"), "value", unit.alias("unit"), told(source).alias("source"), told(version).alias("version"))
    return latest.groupBy("entity").agg(F.sort_array(F.collect_list(item)).alias("refs"))


def values_wide(panel: DataFrame, names: list[str]) -> DataFrame:
    """A row for each entity with a column for each factor, only of status VALUE."""
    return panel.groupBy("entity").pivot("factor", names).agg(F.first(F.when(F.col("status") == VALUE, F.col("raw_value")), ignorenulls=True))
