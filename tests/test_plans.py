"""Steps that grow with the larger tables: results by hand, and plans without the sorts, joins and repeats that made them slow."""

import datetime
import re

from lodestar.operators import blocks, factors, normalize


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def count(df, word):
    return len(re.findall(word, optimized(df)))


def texts(spark, *found):
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")


def test_payouts_of_a_long_text_come_without_window_or_join(spark):
    head = "before\n# A\ncurrency: CNY\n| plan | 公告日 | 除权日 | 进度 | ex_date |\n|---|---|---|---|---|\n"
    lines = "\n".join(f"| 10派{n}元 | 2001-01-02 | 20010203 | 实施 | x |" for n in range(20_000))
    found = blocks.payout_events(texts(spark, head + lines + "\n# B\n| no | word |\n|---|---|\n| 1 | 2 |\n# A\n| plan |\n|---|\n| per 10: 2 |", "| plan |\n|---|\n| per 10: 2 |", None))
    rows = found.collect()
    assert len(rows) == 20_002
    day = datetime.date
    assert sum(r.cash_per_10 for r in rows if r.section == "A") == sum(range(20_000)) + 2
    assert {tuple(r)[1:3] for r in rows if r.status == "implemented"} == {(day(2001, 2, 3), day(2001, 1, 2))}
    assert [tuple(r) for r in rows if r.section == "B"] == [("B", None, None, None, "none", None)]
    assert {r.currency for r in rows if r.section == "A"} == {"CNY"}
    assert count(found, r"\bWindow\b") == count(found, r"\bJoin\b") == 0


def test_valuation_rows_join_only_their_last_days(spark):
    found = blocks.valuation_rows(texts(spark, "**g**: A\n**n**: 1,5\n| date | pe | pb |\n|---|---|---|\n| 20010203 | 1,000 | x |\n| 20010201 | 2 | 3", "**n**: 7"), ("g",), "2001-06-30", {"pe": "x"})
    day = datetime.date
    assert {(r.entity, r.metric, r.day, r.value, r.text_value, r.unit, r.query_dated) for r in found.collect()} == {
        (0, "pe", day(2001, 2, 3), 1000.0, None, "x", False), (0, "pb", day(2001, 2, 3), None, None, None, False), (0, "pe", day(2001, 2, 1), 2.0, None, "x", False), (0, "pb", day(2001, 2, 1), 3.0, None, None, False),
        (0, "g", day(2001, 2, 3), None, "A", None, False), (0, "n", day(2001, 2, 3), 15.0, None, None, False), (1, "n", day(2001, 6, 30), 7.0, None, None, True),
    }
    assert count(found, r"\bJoin\b") == 1


def test_absent_metrics_read_their_rows_once(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None), (1, "b", None, None), (2, "b", None, "x"), (3, "z", 1.0, None), (None, "a", 1.0, None)], "entity long, metric string, value double, text_value string")
    found = blocks.absent_metrics(rows, ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {(1, "b"), (2, "a"), (3, "a"), (3, "b"), (None, "b")}
    assert count(found, r"\bJoin\b") == 0


def test_tables_are_found_once_and_not_again_in_filters(spark):
    found = normalize.table_cells(texts(spark, "| a |\n|---|\n| 1 |", None, "prose"))
    assert [(r.doc_id, r.cell, r.header) for r in found.collect()] == [(0, "1", "a")]
    assert count(found, "regexp_extract_all") == 1


def test_rows_of_tables_are_not_walked_by_lambdas(spark):
    found = normalize.table_cells(texts(spark, "| a | b |\n|---|---|\n|  | - |\n| x\t| y |  "))
    assert [(r.row_no, r.col_no, r.cell, r.header) for r in found.collect()] == [(1, 0, "", "a"), (1, 1, "-", "b"), (2, 0, "x", "a"), (2, 1, "y", "b")]
    # one for the header, one for the message of a row of another width
    assert count(found, r"\btransform\(") <= 2


def test_texts_of_entities_are_made_with_one_shuffle(spark):
    from lodestar.plans import queries_data, queries_more
    from lodestar.plans.day import Day

    day = Day.of(spark, "/root/testdata/sf0.001")
    for found in (queries_data.QUERIES["b7_markdown_tables"](spark, day.sf_dir), queries_more._lines(day.bars_by_entity, "", "trade_date")):
        assert len(re.findall(r"\bExchange\b", found._jdf.queryExecution().executedPlan().toString())) == 1


def test_cells_are_trimmed_of_spaces_alone_where_a_table_has_no_other_blanks(spark):
    found = normalize.table_cells(texts(spark, "\t| a\u3000b\u00a0| c\x1f|\u2003\n|---|\t---|\n\u3000|\u00a01\t2 | \u2003 |\t\n| x | y\u3000\nend", "| p |\r\n|---|\r\n|  q r  |"))
    assert sorted((r.doc_id, r.row_no, r.cell, r.header) for r in found.collect()) == [(0, 1, "", "c"), (0, 1, "1\t2", "a\u3000b"), (0, 2, "x", "a\u3000b"), (0, 2, "y", "c"), (1, 1, "q r", "p")]
    # the other blanks stand only in what is done once for a table
    last = optimized(found).split("Generate")[0]
    assert "\u3000" not in last


def test_cells_of_a_bundle_are_parsed_once(spark):
    cols = "row long, entity string, trade_date string, a string, b string"
    raw = spark.createDataFrame([(1, "e", "2001-01-02", "1", "x"), (2, "e", "2001-01-03", "y", "inf"), (3, " ", "2001-01-04", "z", "1"), (4, "e", "never", "1", "1"), (5, "e", "2001-01-05", "--", None), (6, None, None, "1", "2")], cols)
    seen = []
    typed, failures = normalize.bars(raw, ["a", "b"], lambda parsed: seen.append(parsed) or parsed)
    day = datetime.date
    assert len(seen) == 1 and typed.columns == raw.columns
    assert sorted(map(tuple, typed.collect())) == [(1, "e", day(2001, 1, 2), 1.0, None), (2, "e", day(2001, 1, 3), None, None), (5, "e", day(2001, 1, 5), None, None)]
    told = [(1, "b", "x", "unparsable"), (2, "a", "y", "unparsable"), (2, "b", "inf", "not_finite"), (3, "key", " |2001-01-04", "entity_missing"), (4, "key", "e|never", "date_invalid"), (6, "key", "", "entity_missing")]
    assert sorted(map(tuple, failures.select("row", "column", "cell", "reason").collect())) == told
    # reasons are found in generated code
    assert count(failures, r"\b(filter|array_compact)\(") == count(failures, "lambdafunction") == 0
    assert normalize.numbers(raw, [])[1].count() == 0


def test_newest_rows_are_combined_without_a_sort(spark):
    day = datetime.date
    rows = spark.createDataFrame(
        [(1, "m", day(2001, 3, 31), day(2001, 5, 1), None), (1, "m", day(2000, 3, 31), day(2000, 5, 1), 2.0), (1, "m", day(2001, 6, 30), day(2001, 8, 1), 9.0), (2, "m", day(2001, 6, 30), day(2001, 8, 1), 4.0), (3, "m", None, day(2001, 1, 1), 5.0)],
        "entity long, metric string, report_period date, announce_date date, value double",
    )
    expected = {(1, "m", 2.0, day(2000, 3, 31), day(2000, 5, 1), True), (2, "m", None, None, None, False), (3, "m", 5.0, None, day(2001, 1, 1), True)}
    long = factors.asof_latest(rows, "2001-06-30")
    assert {tuple(r) for r in long.collect()} == expected
    wide = factors.asof_latest(rows.withColumnRenamed("value", "m"), "2001-06-30", metrics=["m"])
    assert {tuple(r) for r in wide.collect()} == expected
    for found in (long, wide):
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_wide_metrics_give_the_factors_of_long_ones(spark):
    day = datetime.date
    rows = [(n, day(2000 + k, 3, 31), day(2000 + k, 5, 1), None if (n + k) % 3 == 0 else n / 7.0, 1.0 - k) for n in range(9) for k in range(3)]
    wide = spark.createDataFrame(rows, "entity long, report_period date, announce_date date, roe_ttm double, inventory double")
    long = normalize.unpivot_metrics(wide, ("entity", "report_period", "announce_date"), ("roe_ttm", "inventory"))
    got = [sorted(map(tuple, factors.metric_factors(r, wide.select("entity").distinct(), "2001-06-30").collect()), key=repr) for r in (wide, long)]
    assert got[0] == got[1] and len(got[0]) == 9 * 13


def test_wide_decisions_do_not_run_as_one_long_method(spark):
    from lodestar.plans import queries_data
    from lodestar.plans.day import METHOD_LIMIT, Day

    Day.of(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(METHOD_LIMIT)) <= 8000
    lists = queries_data.QUERIES["m9_decision"](spark, "/root/testdata/sf0.001")
    assert count(lists, r"\b(filter|transform)\(") == 0  # lambdas are never generated code
    assert {t for r in lists.collect() for t in r.triggers.split(",") if r.decision == "WAIT"} >= {"market conditions change", "lift EXTREME_FOMO", "complete target"}
