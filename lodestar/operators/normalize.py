"""From raw text cells to typed rows: classification, unpivot, entity codes, text blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import classify

#: Words for yes and no in flag cells.
YES = ("true", "1", "yes", "y", "是")
NO = ("false", "0", "no", "n", "否")
#: Columns of a dimension of securities, all as text.
SECURITY = ("entity", "name", "exchange", "list_date", "is_st", "is_delisting", "suspended_days")
#: Prefix of a code and suffix of the canonical id.
EXCHANGES = {"sh": "SH", "sz": "SZ", "bj": "BJ"}


def unpivot_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, value: a row for each key and metric, nulls kept."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def numbers(raw: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """raw with columns as numbers, and its failures: row, column, cell, reason. raw has a column row."""
    parsed = _parsed(raw, columns)
    return parsed.drop(*map(_why, columns)), _unread(parsed, columns)


def _why(column: str) -> str:
    return f"_why_{column}"


def _parsed(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """raw with columns as numbers, and for each a struct of the cell and its reason where it can't be read."""
    parts = {c: classify(F.col(c)) for c in columns}
    told = {_why(c): F.when(why.isNotNull(), F.struct(F.col(c).alias("cell"), why.alias("reason"))) for c, (_, why) in parts.items()}
    return raw.withColumns({c: v for c, (v, _) in parts.items()} | told)


def _unread(parsed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """row, column, cell, reason of parsed rows: a row for each cell that can't be read."""
    return _reported(parsed, {c: (F.col(_why(c)).isNotNull(), F.col(_why(c))["cell"], F.col(_why(c))["reason"]) for c in columns})


def _reported(rows: DataFrame, found: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """row, column, cell, reason: a row for each column whose test holds. found: column to test, cell and reason; tests are made in generated code, not in a lambda."""
    if not found:
        return rows.select("row", F.lit("").alias("column"), F.lit("").alias("cell"), F.lit("").alias("reason")).where(F.lit(False))
    items = [F.struct(F.lit(c).alias("column"), cell.alias("cell"), F.when(test, reason).alias("reason")) for c, (test, cell, reason) in found.items()]
    return rows.where(reduce(Column.__or__, [test for test, _, _ in found.values()])).select("row", F.inline(F.array(*items))).where("reason is not null")


def bars(raw: DataFrame, measures: Sequence[str], settled: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> tuple[DataFrame, DataFrame]:
    """Bars of text cells: rows without an entity or an ISO date are rejected; cells that can't be read are null and reported.

    settled is given the parsed rows, their date in the column _day, and returns them, so that
    a caller of both results can have cells parsed once; columns that it adds stay in the bars.
    """
    day = iso_date("trade_date")
    bad = F.when(F.coalesce(F.trim("entity"), F.lit("")) == "", "entity_missing").when(day.isNull(), "date_invalid")
    parsed = settled(_parsed(raw.withColumns({"_day": day, "_bad": bad}), measures))
    sound = parsed.where("_bad is null")
    rejected = parsed.where("_bad is not null").select("row", F.lit("key").alias("column"), F.concat_ws("|", "entity", "trade_date").alias("cell"), F.col("_bad").alias("reason"))
    return sound.withColumn("trade_date", F.col("_day")).drop("_day", "_bad", *map(_why, measures)), _unread(sound, measures).unionByName(rejected)


def iso_date(column: str) -> Column:
    """A cell as a date, null unless it reads as one of the form 2001-12-31."""
    cell = F.trim(column)
    return F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), cell.try_cast("date"))


def _failures(raw: DataFrame, bad: dict[str, Column], reason: str) -> DataFrame:
    """row, column, cell, reason: a row for each column whose test holds."""
    return _reported(raw, {c: (test, F.col(c), F.lit(reason)) for c, test in bad.items()})


def _require(raw: DataFrame, columns: Sequence[str]) -> None:
    if absent := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"columns are missing: {absent}")


def securities(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows of a dimension of text cells, and the failures: row, column, cell, reason.

    A row with any cell that can't be read is rejected whole, each such cell reported.
    An empty or null count of suspended days is a null; an absent column raises.
    """
    _require(raw, ("row", *SECURITY))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    days = F.trim("suspended_days")
    typed = {"list_date": iso_date("list_date"), "is_st": flag(F.col("is_st")), "is_delisting": flag(F.col("is_delisting")), "suspended_days": F.when(days.rlike(r"^[+-]?\d+$"), days.try_cast("int"))}
    bad = {c: blank(c) if c not in typed else typed[c].isNull() for c in SECURITY}
    bad["suspended_days"] = ~blank("suspended_days") & typed["suspended_days"].isNull()
    whole = ~F.greatest(*[test.cast("int") for test in bad.values()]).cast("boolean")
    rows = raw.where(whole).select("row", *[(typed[c] if c in typed else F.trim(c)).alias(c) for c in SECURITY])
    return rows, _failures(raw, bad, "unreadable")


def statements(raw: DataFrame, metrics: dict[str, tuple[str, str]], as_of: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Observations of text cells known at as_of, a time; failures; one row with the number of rows not yet known; and the metrics' columns that are absent.

    metrics: column to metric and unit.  observations: entity, metric, report_period,
    announce_date, value, unit.  A row without entity, period or announcement is
    rejected, each such cell reported; a value that can't be read is reported and null.
    Cells of rows not yet known are not looked at.
    """
    _require(raw, ("row", "entity", "report_period", "announce_date"))
    there = {c: m for c, m in metrics.items() if c in raw.columns}
    bad = {"entity": F.trim(F.coalesce(F.col("entity"), F.lit(""))) == "", "report_period": iso_date("report_period").isNull(), "announce_date": iso_date("announce_date").isNull()}
    # without an entity the dates are not looked at
    keys = {c: test if c == "entity" else ~bad["entity"] & test for c, test in bad.items()}
    sound = raw.where(~bad["entity"] & ~bad["report_period"] & ~bad["announce_date"])
    dated = sound.withColumns({"entity": F.trim("entity"), "report_period": iso_date("report_period"), "announce_date": iso_date("announce_date")})
    early = available_at(F.col("announce_date")) <= F.lit(as_of).cast("timestamp")
    typed, failures = numbers(dated.where(early), list(there))
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(unit).alias("unit")) for c, (m, unit) in there.items()])
    rows = typed.select("entity", "report_period", "announce_date", F.inline(items))
    return rows, failures.unionByName(_failures(raw, keys, "unreadable")), dated.agg(F.count_if(~early).alias("pending")), [c for c in metrics if c not in there]


def flag(cell: Column) -> Column:
    """A cell as true or false, null if it is neither."""
    plain = F.lower(F.trim(cell))
    return F.when(plain.isin(*YES), True).when(plain.isin(*NO), False)


def canonical(code: Column) -> Column:
    """sh600519 as 600519.SH; null for a prefix that is not known."""
    prefix = F.lower(F.substring(code, 1, 2))
    suffix = F.coalesce(*[F.when(prefix == k, v) for k, v in EXCHANGES.items()])
    return F.when(F.length(code) > 2, F.concat(F.substring(code, F.lit(3), F.length(code)), F.lit("."), suffix))


def code(entity: Column) -> Column:
    """The reverse of canonical."""
    return F.concat(F.lower(F.substring_index(entity, ".", -1)), F.substring_index(entity, ".", 1))


def available_at(day: Column, zone: str = "Asia/Shanghai") -> Column:
    """A date's information is known at 15:00 exchange time."""
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(15), F.lit(0), F.lit(0), F.lit(zone))


#: What ends a line of text, and what is blank within one.
LINE_END = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BLANKS = " \t\x1f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_b = f"[{BLANKS}]*+"
_row = rf"{_b}\|[^\n]*+"
_rule = rf"{_b}:*+-[:-]*+{_b}"
#: A header line, the line of dashes below it, and all lines after these that begin with a bar.
TABLE = rf"(?md)^{_row}\n{_b}\|?{_rule}(?:\|{_rule})*+\|?{_b}(?=\n|\z)(?:\n{_row})*+"
#: **key** at the start of a line, and what follows the first colon after it.
PAIR = rf"(?md)^{_b}\*\*((?:(?!\*\*)[^\n])*+)\*\*[^:\n]*+:([^\n]*+)"


def _may_have(text: Column, marks: str) -> Column:
    """Whether text has one of the ASCII characters marks, or any that is not ASCII: cheap where a pattern costs much for each character."""
    return reduce(lambda found, c: found | F.contains(text, F.lit(c)), marks, F.octet_length(text) > F.char_length(text))


def _lines(text: Column) -> Column:
    return F.when(_may_have(text, "\r\x0b\x0c\x1c\x1d\x1e"), F.regexp_replace(text, LINE_END, "\n")).otherwise(text)


def _spaced(table: Column) -> Column:
    """table, in which only spaces are to be trimmed from lines and cells: blanks beside a bar or a line end are dropped where there are others than spaces."""
    return F.when(_may_have(table, "\t\x1f"), bare(F.regexp_replace(table, rf"{_b}([|\n]){_b}", "$1"))).otherwise(table)


def bare(text: Column) -> Column:
    """text without blanks at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def _trimmed(cell: Column) -> Column:
    """For lambdas, which would give F.trim the place of the cell too."""
    return F.trim(cell)


def _split(line: Column) -> Column:
    """The cells of a line of a spaced table, with their spaces; one bar at its start and one at its end are not between cells."""
    plain = F.trim(line)
    parts = F.split(plain, r"\|", -1)
    n = F.size(parts) - F.when(plain.endswith("|") & (F.size(parts) > 2), 2).otherwise(1)
    return F.slice(parts, F.lit(2), n)


def _cells(line: Column) -> Column:
    """The cells of a line, trimmed."""
    return F.transform(_split(line), _trimmed)


def _wide_as(columns: Column, cells: Column) -> Column:
    """cells, which must be as many as columns."""
    told = F.concat(F.lit("not as wide as its header: "), F.array_join(F.transform(cells, _trimmed), " | "))
    return F.when(F.size(cells) == F.size(columns), cells).otherwise(F.raise_error(told).cast("array<string>"))


def found_tables(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, keep, table_no, columns, table: the Markdown tables within texts, spaced, with the trimmed cells of their headers."""
    # outer: for an inner explode Spark tests its array in a filter first, and so makes it twice
    every = F.posexplode_outer(F.regexp_extract_all(_lines(F.col(text_col)), F.lit(TABLE), F.lit(0))).alias("at", "table")
    found = texts.select(F.col(id_col).alias("doc_id"), *keep, every).where("at is not null").withColumn("table", _spaced(F.col("table")))
    return found.select("doc_id", *keep, (F.col("at") + 1).alias("table_no"), _cells(F.substring_index("table", "\n", 1)).alias("columns"), "table")


def rows_of(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, keep, table_no, row_no, columns, cells of found_tables: a row for each line below the rule; cells may have spaces, and no other blanks, at their ends."""
    lines = found.select("doc_id", *keep, "table_no", "columns", F.posexplode_outer(F.split("table", "\n", -1)).alias("at", "line")).where("at > 1")
    split = lines.select("doc_id", *keep, "table_no", (F.col("at") - 1).alias("row_no"), "columns", _split(F.col("line")).alias("cells"))
    return split.withColumn("cells", _wide_as(F.col("columns"), F.col("cells")))


def tables(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, table_no, columns, rows of the Markdown tables within texts, in order from 1; cells are verbatim.

    A line that begins with a bar is a header only if the next line is a rule: cells of
    dashes and colons, each with a dash.  Only that line is a rule; all lines after it that
    begin with a bar are rows, rows of dashes or of blanks too, with or without a bar at
    their end.  Other lines are prose.  A row that is wider or narrower than its header
    raises.  Null texts have no tables.
    """
    lines = found_tables(texts, id_col=id_col, text_col=text_col).withColumn("lines", F.split("table", "\n", -1))
    rows = F.transform(F.slice("lines", F.lit(3), F.size("lines")), lambda line: F.transform(_wide_as(F.col("columns"), _split(line)), _trimmed))
    return lines.select("doc_id", "table_no", "columns", rows.alias("rows"))


def table_cells(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, table_no, row_no, col_no, cell, header of the tables within texts; rows count from 1, columns from 0."""
    rows = rows_of(found_tables(texts, id_col=id_col, text_col=text_col))
    cells = rows.select("doc_id", "table_no", "row_no", "columns", F.posexplode_outer("cells").alias("col_no", "cell"))
    return cells.select("doc_id", "table_no", "row_no", "col_no", F.trim("cell").alias("cell"), F.get("columns", "col_no").alias("header"))


def bold_pairs(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, value of lines that begin with **key** and have a colon after it; of equal keys the last counts.

    What stands between the key and the colon is left out; an empty key is none.
    """
    lines = texts.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.regexp_extract_all(_lines(F.col(text_col)), F.lit(PAIR), F.lit(0))).alias("at", "line")).where("at is not null")
    pairs = lines.select("doc_id", "at", *[bare(F.regexp_extract("line", PAIR, n)).alias(c) for n, c in ((1, "key"), (2, "value"))])
    return pairs.where("key <> ''").groupBy("doc_id", "key").agg(F.max_by("value", "at").alias("value"))


def flatten_answer(answers: DataFrame, *, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """doc_id, type, desc, content of the nested list data.apiData.apiRecall of each answer."""
    kind = "data struct<apiData: struct<apiRecall: array<struct<type: string, desc: string, content: string>>>>"
    return answers.select(F.col(id_col).alias("doc_id"), F.explode(F.from_json(json_col, kind)["data"]["apiData"]["apiRecall"]).alias("r")).select("doc_id", "r.*")
