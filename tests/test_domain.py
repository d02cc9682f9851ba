"""Operators on small tables made by hand: every status, tie and refusal."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.functions.columns import classify, fail_if_any, nearest_rank, tally, with_percentile
from lodestar.operators import blocks, candidates, decisions, factors, gates, lifecycle, market, normalize, qualify, scoring, validate
from lodestar.sources import landing

AS_OF = "2020-12-31"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "entity long, trade_date date, open double, high double, low double, close double, volume double, amount double")


def bar(entity, n, close=10.0, amount=5.0, high=None):
    return entity, day(n), close, high if high is not None else close, close, close, 1.0, amount


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_windows_are_never_shortened(spark):
    rows = [bar(1, n) for n in range(19)] + [bar(2, n) for n in range(20)] + [bar(3, n) for n in range(21)]
    out = by(factors.price_factors(bars_of(spark, rows), AS_OF), "entity", "factor")
    assert [out[e, "avg_amount_20d"].status for e in (1, 2, 3)] == ["NULL", "VALUE", "VALUE"]
    assert [out[e, "ret_20d"].status for e in (1, 2, 3)] == ["NULL", "NULL", "VALUE"]
    assert out[3, "ret_60d"].raw_value is None


def test_a_hole_makes_null_and_the_future_changes_nothing(spark):
    rows = [bar(1, n, amount=None if n == 5 else 5.0) for n in range(20)] + [bar(2, n) for n in range(20)]
    late = [bar(2, 400 + n, close=99.0, amount=99.0) for n in range(30)]
    a = by(factors.price_factors(bars_of(spark, rows), AS_OF), "entity", "factor")
    b = by(factors.price_factors(bars_of(spark, rows + late), AS_OF), "entity", "factor")
    assert a == b and a[1, "avg_amount_20d"].status == "NULL" and a[2, "avg_amount_20d"].raw_value == 5.0


def test_observation_states(spark):
    d = dt.date
    rows = [
        (1, "roe_ttm", d(2020, 9, 30), d(2020, 10, 30), 7.0), (2, "roe_ttm", d(2020, 12, 31), d(2021, 2, 1), 7.0), (3, "roe_ttm", d(2020, 9, 30), d(2020, 10, 30), None),
        (4, "roe_ttm", d(2020, 9, 30), d(2020, 10, 30), None), (4, "roe_ttm", d(2020, 6, 30), d(2020, 8, 1), 6.0), (5, "roe_ttm", d(2015, 6, 30), d(2015, 8, 1), 5.0),
        (6, "ocf_ttm", d(2020, 9, 30), d(2020, 10, 30), 1.0),
    ]
    obs = spark.createDataFrame(rows, "entity long, metric string, report_period date, announce_date date, value double")
    out = by(factors.metric_factors(obs, obs.select("entity").distinct(), AS_OF).where("factor = 'roe_ttm'"), "entity")
    assert {e[0]: r.status for e, r in out.items()} == {1: "VALUE", 2: "NULL", 3: "NULL", 4: "VALUE", 5: "STALE", 6: "NOT_APPLICABLE"}
    assert out[4,].raw_value == 6.0


@pytest.mark.parametrize("denominator, status, value", [(4.0, "VALUE", 0.5), (0.0, "NOT_APPLICABLE", None), (-4.0, "NOT_APPLICABLE", None), (None, "NULL", None)])
def test_ratios(spark, denominator, status, value):
    d = dt.date
    rows = [(1, m, d(2020, 9, 30), d(2020, 10, 30), v) for m, v in (("ocf_ttm", 2.0), ("net_profit_parent_ttm", denominator))]
    obs = spark.createDataFrame(rows, "entity long, metric string, report_period date, announce_date date, value double")
    r = factors.metric_factors(obs, obs.select("entity").distinct(), AS_OF).where("factor = 'ocf_to_net_profit'").first()
    assert (r.status, r.raw_value) == (status, value)


def test_dividend_states(spark):
    d = dt.date
    events = spark.createDataFrame(
        [(1, d(2020, 6, 1), d(2020, 5, 1), "implemented", 2.0), (1, d(2020, 7, 1), d(2020, 5, 1), "plan", 9.0), (2, d(2015, 6, 1), d(2015, 5, 1), "implemented", 2.0)],
        "entity long, ex_date date, announce_date date, status string, cash_per_10 double",
    )
    out = by(factors.dividend_yield(events, bars_of(spark, [bar(e, 1) for e in (1, 2, 3)]), AS_OF), "entity")
    assert [(out[e,].status, out[e,].raw_value) for e in (1, 2, 3)] == [("VALUE", 2.0), ("VALUE", 0.0), ("NOT_APPLICABLE", None)]


@pytest.mark.parametrize("day, want", [("2001-01-01", 1.0), ("2000-12-31", 0.0), ("2002-01-01", 1.0), ("2002-01-02", 0.0)])
def test_the_years_first_day_counts(spark, day, want):
    dividends = spark.createDataFrame([(1, day, "2000-01-01", 2.0, "implemented")], "entity long, ex_date string, announce_date string, cash_per_10 double, status string").withColumns({c: F.col(c).cast("date") for c in ("ex_date", "announce_date")})
    bars = spark.createDataFrame([(1, "2001-12-31", 20.0)], "entity long, trade_date string, close double").withColumn("trade_date", F.col("trade_date").cast("date"))
    assert factors.dividend_yield(dividends, bars, "2002-01-01").first().raw_value == pytest.approx(want)


def test_event_strength_against_its_sector(spark):
    cases = [(1, 0.02, 0.04, 0.01, True, "x", 1.0, 0.5, 1.0, 1.0), (2, 0.02, -0.01, 0.0, False, " ", 0.0, 1.0, 0.0, 0.0), (3, -0.02, -0.01, None, None, None, None, 0.0, None, 0.0), (4, None, 0.1, 0.0, True, "x", 1.0, None, 1.0, 1.0), (5, 0.5, 0.1, 0.2, True, "x", 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([c[:6] for c in cases], "entity long, stock_1d double, sector_1d double, benchmark_1d double, confirmed boolean, invalidation string")
    assert sorted(map(tuple, decisions.event_ratios(df).collect())) == [(c[0], *c[6:]) for c in cases]


def test_payouts_in_english_and_of_both_kinds(spark):
    text = "# E1\n| 公告日 | 分红方案 | 进度 | 除权日 |\n|---|---|---|---|\n| 2001-01-01 | per 10: 1.5 | implemented | 20010201 |\n| 2001-01-01 | 10派2元 | 实施预案 | 20010301 |\n"
    found = {str(r.ex_date): (r.cash_per_10, r.status) for r in blocks.payout_events(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert found == {"2001-02-01": (1.5, "implemented"), "2001-03-01": (2.0, "none")}


def test_percentile_averages_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 5.0)], "g string, v double")
    assert sorted(r.p for r in with_percentile(df, ["g"], "v", "p").collect()) == [0.25, 0.625, 0.625, 1.0]


def test_ranks_over_parts_equal_sorting(spark):
    values = [(g, float(i * 37 % 1000) if i % 3 else 7.0) for g in ("a", "b") for i in range(6000)] + [("a", None), ("c", None), ("d", -0.0), ("d", 0.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.v): (r.ties, r.before, r.n) for r in tally(df, ["g"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in ("a", "b", "d"):
        held = sorted(v for k, v in values if k == g and v is not None)
        want |= {(g, v): (held.count(v), held.index(v), len(held)) for v in set(held)}
    assert got == want
    assert tally(df.where("v is null"), ["g"], "v").count() == 0
    assert {r.g: r.p for r in with_percentile(df.where("g > 'b'"), ["g"], "v", "p").collect()} == {"c": None, "d": 0.75}


@pytest.mark.parametrize("n, want", [(2, 1.0), (6, 3.0), (11, 6.0)])
def test_nearest_rank_rounds_half_to_even(spark, n, want):
    df = spark.createDataFrame([("g", float(i + 1)) for i in range(n)], "g string, v double")
    assert nearest_rank(df, ["g"], "v", {"p50": 0.5}).first().p50 == want


def panel_of(spark, rows):
    return spark.createDataFrame(rows, "entity long, factor string, status string, raw_value double")


def test_ineligible_entities_do_not_move_ranks(spark):
    spec = scoring.spec(spark, {"s": (("a", 1.0), ("b", -1.0))})
    rows = [(e, f, "VALUE", float(e * (1 if f == "a" else -1))) for e in (1, 2, 3) for f in "ab"]
    plain = by(scoring.score(panel_of(spark, rows), spec), "entity")
    mixed = by(scoring.score(panel_of(spark, [*rows, (9, "a", "VALUE", 999.0), (9, "b", "NULL", None)]), spec), "entity")
    assert plain == mixed and plain[3,].score == 100.0 and plain[1,].rank_percentile == pytest.approx(1 / 3)
    alone = scoring.score(panel_of(spark, rows[:2]), spec).first()
    assert alone.score == 100.0 and alone.rank_percentile is None
    with pytest.raises(ValueError):
        scoring.spec(spark, {"s": (("a", 0.0),)})


def test_limits_are_inclusive_and_fail_closed(spark):
    limits = qualify.thresholds(spark, (("s", "a", 5.0, 10.0),))
    results = spark.createDataFrame([("s", e, True, 0.95) for e in range(1, 6)], "strategy string, entity long, eligible boolean, rank_percentile double")
    panel = panel_of(spark, [(1, "a", "VALUE", 5.0), (2, "a", "VALUE", 10.0), (3, "a", "VALUE", 10.1), (4, "a", "NULL", None)])
    out = by(qualify.qualify(results, panel, limits), "entity")
    assert [out[e,].qualified for e in range(1, 6)] == [True, True, False, False, False]
    with pytest.raises(ValueError):
        qualify.qualify(results.withColumn("strategy", F.lit("other")), panel, limits)


def test_missing_evidence_raises(spark):
    row = spark.createDataFrame([(1, "value", 0.1, None, 0.9, 1.0, 3.0, 1.1, 0.1, 0.1)], "entity long, strategy string, ret_20d double, avg_amount_20d double, ret_60d double, proximity_52w_high double, dividend_yield_ttm double, volume_ratio double, relative_strength double, industry_excess double")
    with pytest.raises(ValueError, match="avg_amount_20d"):
        market.validate(row, veto_below=1.0, plenty=2.0)


def test_selection_keeps_the_reserve_and_the_cap(spark):
    quals = [(f"s{e % 6}", e, 0.9 + (e % 10) / 100, True) for e in range(60)]
    qualified = spark.createDataFrame(quals, "strategy string, entity long, rank_percentile double, qualified boolean")
    checked = spark.createDataFrame([(e, f"s{e % 6}", "CONTRADICTED" if e == 9 else "NEUTRAL", "NO_SIGNAL") for e in range(60)], "entity long, strategy string, validation string, signal string")
    rows = candidates.assemble(qualified, checked)
    chosen = candidates.select(rows, qualified).orderBy("position").collect()
    assert len(chosen) == 50 and 9 not in {r.entity for r in chosen} and [r.position for r in chosen] == list(range(1, 51))
    assert [(-r.best, r.entity) for r in chosen] == sorted((-r.best, r.entity) for r in chosen)
    assert len(candidates.select(rows, qualified, each=3, cap=5).collect()) == 18
    with pytest.raises(ValueError):
        candidates.assemble(qualified, checked.where("entity <> 5"))


def test_cells(spark):
    df = spark.createDataFrame([(c,) for c in ("1.5", " 2 ", "-", "N/A", "", None, "abc", "inf", "nan")], "c string")
    value, reason = classify(F.col("c"))
    assert [(r.v, r.r) for r in df.select(value.alias("v"), reason.alias("r")).collect()] == [(1.5, None), (2.0, None), (None, None), (None, None), (None, None), (None, None), (None, "unparsable"), (None, "not_finite"), (None, None)]


def test_merge_replaces_appends_and_widens(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(2, "c", 7), (3, "d", 8)], "k long, v string, z long")
    out = by(landing.merge(old, new, ["k"]), "k")
    assert [tuple(out[k,]) for k in (1, 2, 3)] == [(1, "a", "x", None), (2, "c", None, 7), (3, "d", None, 8)]
    with pytest.raises(ValueError):
        landing.merge(old, new.drop("k"), ["k"])


def test_snapshots_refuse_other_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    write = lambda d: landing.write_snapshot(d, f"file://{tmp_path}", "factor", "2020-01-01")
    assert write(df) == "written" and write(df.repartition(3)) == "same"
    with pytest.raises(ValueError):
        write(df.limit(1))


def test_ragged_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    good, bad = landing.raw_csv(spark, str(tmp_path / "x.csv"), ["a", "b"])
    assert [tuple(r) for r in good.collect()] == [("1", "2")] and bad.count() == 2


def test_gates_drop_all_copies(spark):
    rows = [(1, day(1), 5.0, 1.0), (1, day(1), 5.0, 1.0), (1, day(2), None, 1.0), (1, day(3), -1.0, 1.0), (1, day(4), 5.0, -1.0), (1, day(5), 5.0, 1.0)]
    bars = spark.createDataFrame(rows, "entity long, trade_date date, close double, volume double")
    issues = gates.bar_issues(bars)
    assert [r.trade_date for r in gates.valid_bars(bars, issues).collect()] == [day(5)]
    assert gates.bar_issues(bars.limit(0)).first().rule == "dataset_empty"


def test_transitions(spark):
    states = ["signup", "view", "purchase", "view", "error", "click"]
    events = spark.createDataFrame([(1, n, n, s) for n, s in enumerate(states)], "entity long, event_id long, ts long, state string")
    assert [r.verdict for r in lifecycle.transitions(events).orderBy("ts").collect()] == ["ACCEPTED", "ACCEPTED", "NOT_NEXT", "NOT_NEXT", "RESERVED", "ACCEPTED"]
    assert tuple(lifecycle.fold_states(events).first()) == (1, "click", 3)


def test_transitions_keep_time_and_end(spark):
    told = [(1, 1, 5, "view"), (1, 2, 5, "signup"), (1, 3, 4, "view"), (1, 4, 5, "view"), (1, 5, 6, "view"), (1, 6, 7, "click"), (1, 7, 8, "purchase"), (1, 8, 9, "signup"), (1, 9, 9, None), (2, 1, 1, None)]
    events = spark.createDataFrame(told, "entity long, event_id long, ts long, state string")
    out = {(r.entity, r.event_id): r for r in lifecycle.transitions(events).collect()}
    assert [out[1, n].verdict for n in range(1, 10)] == ["NOT_FIRST", "ACCEPTED", "BACKWARDS", "ACCEPTED", "NOT_NEXT", "ACCEPTED", "ACCEPTED", "AT_END", "AT_END"]
    assert [out[1, n].held for n in (1, 2, 3, 9)] == [None, None, "signup", "purchase"] and out[2, 1].verdict == "NOT_FIRST"
    assert out[1, 5].refusal == "1 cannot move to view: only click follows view" and out[1, 4].refusal is None
    assert lifecycle.transitions(events.limit(0)).count() == 0


def test_vetoes_and_replay(spark):
    dims = sorted({d for ws in decisions.PROFILES.values() for d in ws})
    base = dict(profile="EVENT", invalidation="x", nav=1.0, quantity=1, validation="NEUTRAL", signal="NO_SIGNAL", action="OPEN", losing=False, new_confirmation=None, sector_1d=0.01, stock_1d=0.01, benchmark_1d=0.0, confirmed=True, target=1.0, fomo=0, priced_in=False)
    cases = [
        ({}, 1.0, "PASS", []), ({"fomo": 8}, 1.0, "WAIT", ["lift EXTREME_FOMO"]), ({"fomo": 10}, 0.1, "WAIT", ["lift EXTREME_FOMO"]), ({"priced_in": True, "profile": "SWING"}, 0.75, "WAIT", ["market conditions change"]),
        ({"confirmed": None, "profile": "POSITION"}, 0.5, "NO_TRADE", []), ({"invalidation": " "}, 1.0, "NO_TRADE", []), ({"action": "ADD", "losing": True, "new_confirmation": "volume"}, 1.0, "PASS", []),
        ({"confirmed": None}, 1.0, "WAIT", ["complete confirmed", "lift NO_PRICE_CONFIRMATION"]),
    ]
    rows = [(n, *{**base, **c}.values(), *[ratio] * len(dims)) for n, (c, ratio, _, _) in enumerate(cases)]
    kinds = "string string double int string string string boolean string double double double boolean double int boolean".split()
    df = spark.createDataFrame(rows, ", ".join(["id int", *[f"{c} {k}" for c, k in zip(base, kinds, strict=True)], *[f"{d} double" for d in dims]]))
    done = decisions.evaluate(df)
    assert [(r.decision, r.triggers) for r in done.orderBy("id").collect()] == [(c[2], c[3]) for c in cases]
    again = decisions.replay(done, {"EVENT": {"catalyst_quality": 0.0, "risk_plan": -0.0}}).orderBy("id").collect()
    assert [(r.score, r.decision) for r in again[:3]] == [(75.0, "WAIT"), (75.0, "WAIT"), (7.5, "NO_TRADE")] and again[0].triggers == ["verify the stored evidence again"]
    with pytest.raises(Exception, match="fomo"):
        decisions.evaluate(df.withColumn("fomo", F.lit(11))).collect()


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.75, 0.75), (3, 0.1, 0.1), (4, None, 1.0)], "id long, a double, b double")
    scored = decisions.dimension_scores(rows, {"a": 50.0, "b": 50.0})
    none = F.array().cast("array<string>")
    out = {r.id: (r.score, r.d) for r in scored.withColumn("d", decisions.decide(F.col("score"), none, none, F.col("missing"))).collect()}
    assert out == {1: (100.0, "PASS"), 2: (75.0, "WAIT"), 3: (10.0, "NO_TRADE"), 4: (50.0, "WAIT")}


def test_codes_and_blocks(spark):
    df = spark.createDataFrame([(1, "sh600519"), (2, "xx1"), (3, "")], "i long, c string")
    assert [r.e for r in df.orderBy("i").select(normalize.canonical(F.col("c")).alias("e")).collect()] == ["600519.SH", None, None]
    text = spark.createDataFrame([(1, "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny\n| no | rule |\n| so | prose |\ny\n| c |\n|---|\n| 3 |\n**k**: v\n**k**: w")], "doc_id long, text string")
    assert sorted((r.table_no, r.header, r.cell) for r in normalize.table_cells(text).collect()) == [(1, "a", "1"), (1, "b", "2"), (2, "c", "3")]
    assert [tuple(r) for r in normalize.bold_pairs(text).collect()] == [(1, "k", "w")]


def test_rows_of_text_cells(spark):
    cols = "row int, entity string, name string, exchange string, list_date string, is_st string, is_delisting string, suspended_days string"
    rows = [(1, "a", "n", "X", "2001-02-03", "是", "否", ""), (2, "", None, "X", "2001-02-30", "?", "0", "x"), (3, "c", "n", "X", "2001-02-03", "no", "Y", "7")]
    good, bad = normalize.securities(spark.createDataFrame(rows, cols))
    assert [(r.row, r.is_st, r.is_delisting, r.suspended_days) for r in good.orderBy("row").collect()] == [(1, True, False, None), (3, False, True, 7)]
    assert sorted(r.column for r in bad.collect()) == ["entity", "is_st", "list_date", "name", "suspended_days"]
    with pytest.raises(ValueError, match="is_st"):
        normalize.securities(spark.createDataFrame(rows, cols).drop("is_st"))
    sheet = spark.createDataFrame([(1, "a", "2020-12-31", "2021-03-01", "5"), (2, "a", "2020-12-31", "2021-03-02", "bad"), (3, "a", "x", "y", "5"), (4, None, "x", "y", "5"), (5, "b", "2020-12-31", "2021-02-01", "bad")], "row int, entity string, report_period string, announce_date string, r string")
    seen, failed, pending, absent = normalize.statements(sheet, {"r": ("revenue", "yuan"), "z": ("zeal", "-")}, "2021-03-01 15:00:00+08:00")
    assert sorted((r.entity, r.metric, r.value, r.unit) for r in seen.collect()) == [("a", "revenue", 5.0, "yuan"), ("b", "revenue", None, "yuan")]
    assert sorted((r.row, r.column) for r in failed.collect()) == [(3, "announce_date"), (3, "report_period"), (4, "entity"), (5, "r")] and pending.first().pending == 1 and absent == ["z"]
    with pytest.raises(Exception, match="as wide as its header"):
        normalize.table_cells(spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 |")], "doc_id long, text string")).collect()


def test_guard(spark):
    fail_if_any(spark.range(0), "none")
    with pytest.raises(ValueError, match="some"):
        fail_if_any(spark.range(1), "some")


def test_backfill_stops(spark):
    asked = spark.createDataFrame([(e,) for e in range(1, 5)], "entity long")
    came = lambda rows, most=None: [tuple(r) for r in landing.gap_ledger(asked, spark.createDataFrame(rows, "entity long, round long"), most).orderBy("round").collect()]
    assert came([(1, 1), (2, 1), (2, 2), (None, 2), (3, 3)]) == [(1, 4, 2, 2, None), (2, 2, 0, 2, "no_progress")]
    assert came([(1, 1), (2, 2), (3, 2), (4, 2), (9, 3)]) == [(1, 4, 1, 3, None), (2, 3, 3, 0, "covered")]
    assert came([(1, 1), (2, 2), (3, 3)], 2) == [(1, 4, 1, 3, None), (2, 3, 1, 2, "max_rounds")]
    assert came([]) == []


def test_manifest_rules(spark):
    rows = [("d1", "A", "SUCCESS", 1, 2, None), ("d1", "A", "FAILED", 1, 2, None), ("d1", "X", "LOST", None, None, None), ("d2", "B", "RUNNING", 2, 1, "e"), ("d2", None, "SUCCESS", 1, None, "")]
    log = spark.createDataFrame(rows, "day string, stage string, status string, started_at int, finished_at int, error string")
    found = {r.rule: r.n for r in validate.manifest_findings(log, ["A", "B"]).collect()}
    assert found == {"UNKNOWN_STAGE": 1, "DUPLICATE_STAGE": 1, "MISSING_STAGE": 2, "STATUS": 1, "FINISHED": 2, "ERROR": 2, "TIME": 2}
    assert {r.n for r in validate.manifest_findings(log.limit(0), ["A", "B"]).collect()} == {0}
