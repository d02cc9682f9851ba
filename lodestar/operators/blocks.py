"""Text blocks of valuations, payouts and listings to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import classify
from lodestar.operators.normalize import bold_pairs, found_tables, rows_of, table_cells

#: Header words of payout tables and what they name.
HEADERS = (("ex_date", "除权|ex.?date"), ("announce_date", "公告|announce"), ("plan", "方案|plan|payout"), ("status", "进度|status"))


def valuation_rows(blocks: DataFrame, labels: tuple[str, ...], query_day: str, units: dict[str, str] | None = None) -> DataFrame:
    """entity, metric, day, value, text_value, unit, query_dated of blocks(doc_id, text).

    Table cells are dated by the first column of their row (YYYYMMDD); header
    pairs by the table's latest date, or the query's where there is no table (query_dated).
    Thousands separators are dropped; label metrics keep their text.
    """
    lines = rows_of(found_tables(blocks)).withColumn("day", F.try_to_date(F.trim(F.get("cells", F.lit(0))), "yyyyMMdd"))
    number = lambda c: classify(F.replace(c, F.lit(","), F.lit("")))[0]
    cells = lines.select("doc_id", "columns", "day", F.posexplode_outer("cells").alias("col_no", "cell")).where("col_no > 0")
    rows = cells.select("doc_id", F.get("columns", "col_no").alias("metric"), "day", number(F.col("cell")).alias("value"), F.lit(None).cast("string").alias("text_value"), F.lit(False).alias("query_dated"))
    latest = lines.groupBy("doc_id").agg(F.max("day").alias("last"))
    pairs = bold_pairs(blocks).join(latest, "doc_id", "left")
    is_label = F.col("key").isin(*labels)
    heads = pairs.select("doc_id", F.col("key").alias("metric"), F.coalesce("last", F.lit(query_day).cast("date")).alias("day"), F.when(~is_label, number("value")).alias("value"), F.when(is_label, F.col("value")).alias("text_value"), F.col("last").isNull().alias("query_dated"))
    unit = reduce(lambda found, u: F.when(F.col("metric") == u[0], u[1]).otherwise(found), (units or {}).items(), F.lit(None).cast("string"))
    return rows.unionByName(heads).select(F.col("doc_id").alias("entity"), "metric", "day", "value", "text_value", unit.alias("unit"), "query_dated")


def absent_metrics(rows: DataFrame, expected: list[str]) -> DataFrame:
    """entity, metric: those expected that an entity's rows hold neither as a number nor as a text."""
    valued = F.col("value").isNotNull() | F.col("text_value").isNotNull()
    names = {f"_{n}": m for n, m in enumerate(expected)}
    # a flag for each metric, not a set: flags are combined before the shuffle, without a sort
    every = rows.groupBy("entity").agg(*[F.max((F.col("metric") == m) & valued).alias(c) for c, m in names.items()])
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in names.items()]))
    return every.select("entity", F.explode_outer(lacking).alias("metric")).where("metric is not null")


#: A line '# name' and all lines below it before the next such line.
SECTION = r"(?md)^# [^\n]*+(?:\n(?!# )[^\n]*+)*+"


def _role(header: Column) -> Column:
    """What a header names: the first of HEADERS whose words it has."""
    role = F.lit(None).cast("string")
    for name, pattern in reversed(HEADERS):
        role = F.when(F.lower(header).rlike(pattern), name).otherwise(role)
    return F.coalesce(role, F.lit(""))


def payout_events(texts: DataFrame) -> DataFrame:
    """section, ex_date, announce_date, cash_per_10, status, currency of payout tables; columns are known by words of their headers.

    The section of a table is the last line '# name' before it.  A status that
    speaks of both a plan and its implementation is none, so such an event counts as
    neither.  The currency is named in the section, else null.
    """
    parts = texts.select("doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(SECTION), F.lit(0))).alias("at", "part")).where("at is not null")
    named = F.trim(F.substring(F.substring_index("part", "\n", 1), 3, 2**31 - 1))
    split = parts.groupBy("doc_id", named.alias("section")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n").alias("text"))
    named_unit = F.nullif(F.regexp_extract("text", r"(?i)(?:货币单位|currency)[：:]\s*([^\s|]+)", 1), F.lit(""))
    currency = F.coalesce(named_unit, F.when(F.col("text").rlike("CNY|人民币"), "CNY"))
    # places of the named columns, 0 for none: once for a table, not for each of its rows
    roles, at = F.transform("columns", _role), {name: f"_{name}" for name, _ in HEADERS}
    found = found_tables(split.withColumn("currency", currency), keep=("section", "currency")).withColumn("_roles", roles)
    placed = found.withColumns({c: F.array_position("_roles", name).cast("int") for name, c in at.items()})
    rows = rows_of(placed, keep=("section", "currency", *at.values()))
    wide = rows.select("section", "currency", *[F.when(F.col(c) > 0, F.trim(F.get("cells", F.col(c) - 1))).alias(name) for name, c in at.items()])
    # by its marks, as a form that fails costs an exception
    plain = lambda c: F.try_to_date(c, "yyyyMMdd")
    date = lambda c: F.when(F.contains(F.col(c), F.lit("/")), F.try_to_date(c, "yyyy/MM/dd")).when(F.contains(F.col(c), F.lit("-")), F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), plain(c))).otherwise(plain(c))
    amount = r"10\s*派\s*([0-9.]+)|per 10:? ([0-9.]+)"
    cash = F.coalesce(*[F.nullif(F.regexp_extract("plan", amount, k), F.lit("")).try_cast("double") for k in (1, 2)])
    done, planned = F.lower("status").rlike("实施|implemented"), F.lower("status").rlike("预案|plan")
    status = F.when(done & ~planned, "implemented").when(planned & ~done, "plan").otherwise("none")
    return wide.select("section", date("ex_date").alias("ex_date"), date("announce_date").alias("announce_date"), cash.alias("cash_per_10"), status.alias("status"), "currency")


def constituents(texts: DataFrame) -> DataFrame:
    """grp, entity, name of listings whose first line names the group; a listing that names another raises. Of equal entities the last counts.

    texts: doc_id, grp, text.
    """
    from lodestar.functions.columns import fail_if_any

    fail_if_any(texts.where(~F.contains(F.get(F.split("text", "\n"), F.lit(0)), F.col("grp"))).select("doc_id"), "listings of another group")
    cells = table_cells(texts).join(texts.select("doc_id", "grp"), "doc_id")
    wide = cells.groupBy("grp", "doc_id", "table_no", "row_no").pivot("header", ["code", "name"]).agg(F.first("cell"))
    return wide.groupBy("grp", F.col("code").alias("entity")).agg(F.max_by("name", F.struct("table_no", "row_no")).alias("name"))
