"""Versions, citations, replays, trade references, snapshots expected and guards, on rows made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import artifacts, bundle, decisions, gates, lifecycle, lineage, trades

DAY = dt.date(2020, 1, 2)
CITED = "array<struct<factor: string, factor_version: string, status: string, raw_value: double>>"
CANDIDATE = f"""entity long, primary_strategy string, validation string, signal string, action string, risks array<string>, policy_version string,
  results array<struct<strategy: string, strategy_version: string, score: double, rank_percentile: double, cited: {CITED}, factor_versions: string>>,
  qualifications array<struct<strategy: string, qualification_version: string, qualified: boolean, rank_percentile: double>>,
  lineage struct<factor: string, strategy: string, qualification: string, candidate_policy: string, regime: string, market_validation: string, signal: string>"""


def candidate(entity=1, **changes):
    row = {
        "entity": entity, "primary_strategy": "a", "validation": "CONFIRMED", "signal": "BREAKOUT", "action": "WATCH", "risks": [], "policy_version": "p1",
        "results": [("a", "a1", 90.0, 0.9, [("f", "f1", "VALUE", 5.0)], "f1"), ("b", "b2", 80.0, 0.8, [("f", "f1", "VALUE", 5.0), ("g", "f2", "NULL", None)], "f1,f2")],
        "qualifications": [("a", "q1", True, 0.9), ("b", "q1", True, 0.8)], "lineage": ("f1,f2", "a1,b2", "q1", "p1", "r1", "m1", "s1"),
    }
    return tuple((row | changes).values())


def told(df):
    return sorted((r.check, r.entity, r.observed) for r in df.collect())


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), CANDIDATE)


def test_versions_are_merged_from_panel_to_candidate(spark):
    panel = spark.createDataFrame([(1, "f", "v2", "VALUE", 1.0), (1, "g", "v1", "NULL", None), (2, "f", "v2", "VALUE", 2.0)], "entity long, factor string, factor_version string, status string, raw_value double")
    weights = spark.createDataFrame([("a", "g", 1.0, 0), ("a", "f", 1.0, 1), ("b", "f", 1.0, 0)], "strategy string, factor string, weight double, pos int")
    results = spark.createDataFrame([("a", 1, 90.0), ("b", 1, 80.0), ("a", 2, 70.0), ("b", 3, 60.0)], "strategy string, entity long, score double")
    cited = lineage.cite_factors(results, panel, weights, {"a": "a1", "b": "b1"})
    got = {(r.strategy, r.entity): (r.strategy_version, r.factor_versions, [(c.factor, c.factor_version) for c in r.cited]) for r in cited.collect()}
    assert got == {("a", 1): ("a1", "v1,v2", [("g", "v1"), ("f", "v2")]), ("b", 1): ("b1", "v2", [("f", "v2")]), ("a", 2): ("a1", "v2", [("f", "v2")]), ("b", 3): ("b1", None, [])}
    qualified = spark.createDataFrame([(1, "a", True, 0.9), (1, "b", True, 0.8), (2, "a", False, 0.7), (3, "b", True, 0.6), (3, "c", True, 0.5)], "entity long, strategy string, qualified boolean, rank_percentile double")
    whole = lineage.cite_results(spark.createDataFrame([(1,), (2,), (3,)], "entity long"), qualified, cited)
    rows = {r.entity: r for r in whole.collect()}
    assert (rows[1].lineage.factor, rows[1].lineage.strategy, rows[1].lineage.qualification) == ("v1,v2", "a1,b1", "qualification-2")
    assert [r.strategy for r in rows[1].results] == ["a", "b"] and rows[2].results is None
    # entity 3 is qualified for c, of which no result is stored: a qualification without a citation
    assert [r.strategy for r in rows[3].results] == ["b"] and [q.strategy for q in rows[3].qualifications] == ["b", "c"]
    versions = {r.kind: (r.versions, r.n) for r in lineage.versions_of(cited, ["strategy_version", "factor_versions"]).collect()}
    assert versions == {"strategy_version": ("a1,b1", 0), "factor_versions": ("v1,v2", 1)}


def test_citations_of_what_is_not_stored(spark):
    rows = candidates(spark, candidate(1), candidate(2), candidate(3))
    results = spark.createDataFrame([(1, "a", "a1"), (1, "b", "b2"), (2, "a", "a0"), (2, "b", "b2"), (3, "a", "a1")], "entity long, strategy string, strategy_version string")
    panel = spark.createDataFrame([(e, f, v) for e in (1, 2, 3) for f, v in (("f", "f1"), ("g", "f2")) if (e, f) != (2, "g")] + [(2, "g", "f9")], "entity long, factor string, factor_version string")
    assert told(lineage.orphans(rows, results, panel)) == [("FACTOR", 2, "g f2"), ("QUALIFIED", 3, "b"), ("STRATEGY", 2, "a a1"), ("STRATEGY", 3, "b b2")]


def test_versions_that_are_not_declared(spark):
    full = ("f1", "a1, b2", "q1", "p1", "r1", "m1", "s1")
    rows = candidates(
        spark, candidate(1), candidate(2, lineage=("", "a1", "q2", "p1", None, "m1", "s1")), candidate(3, lineage=full, policy_version=" "),
        candidate(4, lineage=("f1", "a1,b2", "", "p1", "r1", "m1", "s1"), qualifications=[("a", None, True, 0.9), ("b", "q9", True, 0.8)]), candidate(5, results=[("a", None, 1.0, 0.5, [], None)]),
    )
    assert told(lineage.undeclared(rows)) == [("EMPTY", 2, "factor"), ("EMPTY", 2, "regime"), ("EMPTY", 3, "policy_version"), ("EMPTY", 4, "qualification"), ("QUALIFICATION", 2, "a q1"), ("QUALIFICATION", 2, "b q1"), ("STRATEGY", 2, "b b2"), ("STRATEGY", 5, "a ")]


def test_rules_of_candidates(spark):
    rows = candidates(
        spark, candidate(1), candidate(2, validation="CONTRADICTED"), candidate(3, signal="BREAKDOWN"), candidate(4, signal="TREND_WEAKEN", action="BUY", risks=["x"]), candidate(5, signal="TREND_WEAKEN", risks=["trend weakens"]),
        candidate(6, signal="NO_SIGNAL", action=None), candidate(7, qualifications=[("a", "q1", False, 0.9)]), candidate(8, primary_strategy="b"), candidate(9, primary_strategy="c"), candidate(10, primary_strategy=" "),
        candidate(11, results=[]), candidate(12, qualifications=[("b", "q1", True, 0.9), ("a", "q1", True, 0.9)]), candidate(13), candidate(13), candidate(14, results=None, qualifications=None, risks=None),
    )
    assert told(artifacts.candidate_rules(rows)) == [
        ("ACTION", 4, "TREND_WEAKEN BUY"), ("ACTION", 6, "NO_SIGNAL"), ("BREAKDOWN", 3, "BREAKDOWN"), ("CONTRADICTED", 2, "CONTRADICTED"), ("NONE_QUALIFIED", 7, ""), ("NONE_QUALIFIED", 14, ""),
        ("NO_RESULT", 11, "a"), ("NO_RESULT", 11, "b"), ("PRIMARY", 8, "b a"), ("PRIMARY", 9, "c a"), ("PRIMARY", 10, "  a"), ("RISK", 4, "TREND_WEAKEN"), ("TWICE", 13, "2"),
    ]
    many = rows.limit(1).drop("entity").crossJoin(spark.range(1, 52).withColumnRenamed("id", "entity"))
    assert told(artifacts.candidate_rules(many)) == [("COUNT", None, "51")] and told(artifacts.candidate_rules(many.where("entity < 51"))) == []


def test_liquidity_is_replayed_from_bars(spark):
    bars = [(e, DAY + dt.timedelta(days=n), amount) for e, amount in ((1, 100.0), (2, 10.0), (3, 100.0), (4, 100.0)) for n in range(25)] + [(2, DAY + dt.timedelta(days=99), 1e9)]
    bars = [(e, d, None if (e, d) == (4, DAY + dt.timedelta(days=20)) else a) for e, d, a in bars]
    table = spark.createDataFrame(bars, "entity long, trade_date date, amount double")
    cite = lambda v: [("a", "a1", 90.0, 0.9, [("avg_amount_20d", "f1", "VALUE", v)], "f1")]
    rows = candidates(spark, candidate(1, results=cite(100.0)), candidate(2, results=cite(100.0)), candidate(3, results=cite(30.0)), candidate(4, results=cite(100.0)), candidate(5, results=[]))
    found = artifacts.liquidity_replay(rows, table, "2020-02-15", least=50.0)
    assert told(found) == [("AMOUNT", 2, "100.0"), ("AMOUNT", 3, "30.0"), ("AMOUNT", 4, "100.0"), ("LIQUIDITY", 2, "10.0"), ("LIQUIDITY", 3, "30.0")]


def test_records_references_and_regimes(spark):
    at = dt.datetime(2020, 1, 2, 7)
    rows = spark.createDataFrame([(1, 50.0, "a", at), (2, 101.0, "a", at), (3, float("nan"), "z", at), (4, None, None, None), (5, 1.0, " ", at + dt.timedelta(hours=1))], "entity long, score double, name string, at timestamp")
    found = artifacts.record_rules(rows, ranges={"score": (0.0, 100.0)}, required=["name"], vocabularies={"name": ["a"]}, moment="at", as_of="2020-01-02 15:00:00+08:00")
    assert [(r.check, r.entity) for r in found.orderBy("check", "entity").collect()] == [("RANGE", 2), ("RANGE", 3), ("REQUIRED", 4), ("REQUIRED", 5), ("TIME", 4), ("TIME", 5), ("UNKNOWN", 3)]
    refs = spark.createDataFrame([(1, [("m", DAY, at), ("bare", None, None)]), (2, [("m", DAY, None), ("late", DAY, at + dt.timedelta(days=1))]), (3, None)], "entity long, refs array<struct<metric: string, period: date, known_at: timestamp>>")
    assert [(r.entity, r.observed.split()[0]) for r in artifacts.availability(refs, "2020-01-02 15:00:00+08:00").collect()] == [(2, "m"), (2, "late")]
    odd = candidates(spark, candidate(1), candidate(2, results=[("a", "a1", 100.5, -0.1, [], None), ("b", "b1", None, None, [], None)]))
    assert [(c, e) for c, e, _ in told(artifacts.cited_scores(odd))] == [("PERCENTILE", 2), ("SCORE", 2)]
    regime = lambda *names: told(artifacts.regime_rules(spark.createDataFrame([(n,) for n in names], "regime string")))
    assert regime("BULL") == [] and regime() == [("ONE", None, "0")] and regime("BULL", None) == [("ONE", None, "2"), ("REGIME", None, None)] and regime("x") == [("REGIME", None, "x")]


def test_contexts_of_many_days(spark):
    days = [DAY + dt.timedelta(days=n) for n in range(3)]
    at = lambda d, h: dt.datetime(d.year, d.month, d.day, h)
    intents = spark.createDataFrame([(1, 1, days[0], at(days[0], 10)), (2, 1, days[1], at(days[1], 10)), (3, 2, days[1], at(days[1], 10)), (4, 1, days[2], at(days[2], 1))], "intent_id long, entity long, as_of date, at timestamp")
    panel = spark.createDataFrame([(days[0], 1, "ret_20d", "VALUE", 0.1), (days[1], 1, "ret_20d", "STALE", 0.2), (days[1], 1, "volume_ratio", "VALUE", 0.7), (days[2], 1, "other", "VALUE", 0.3)], "as_of date, entity long, factor string, status string, raw_value double")
    results = spark.createDataFrame([(days[0], 1, "b", 1.0, 0.5), (days[0], 1, "a", 2.0, 0.6)], "as_of date, entity long, strategy string, score double, rank_percentile double")
    chosen = spark.createDataFrame([(days[1], 1, "CONFIRMED", "BREAKOUT", "l")], "as_of date, entity long, validation string, signal string, lineage string")
    seen = [(1, at(days[0], 9), 1.0, 0.4), (1, at(days[0], 10), 2.0, 0.5), (1, at(days[0], 11), 3.0, 0.6), (1, at(days[1], 9), 4.0, 0.9)]
    overlays = spark.createDataFrame([(e, t, s, 0.0, 0.0, True, v, 1.0) for e, t, s, v in seen], "entity long, seen_at timestamp, stock_1d double, sector_1d double, benchmark_1d double, confirmed boolean, volume_ratio_now double, price double")
    rows = {r.intent_id: r for r in trades.context(intents, panel, results, chosen, overlays).collect()}
    assert [rows[n].candidate_status for n in (1, 2, 3, 4)] == ["not_published", "published", "not_selected", "not_published"]
    assert [rows[n].ret_20d for n in (1, 2, 3, 4)] == [0.1, None, None, None] and [s.strategy for s in rows[1].strategies] == ["a", "b"] and rows[2].strategies == []
    assert [rows[n].stock_1d for n in (1, 2, 3, 4)] == [2.0, 4.0, None, None]  # the newest of the day, not the later one
    assert [rows[n].volume for n in (1, 2, 3, 4)] == [0.5, 0.7, None, None] and rows[2].signal == "BREAKOUT"
    with pytest.raises(ValueError, match="without any snapshot"):
        trades.context(intents.withColumn("as_of", F.date_add("as_of", 9)), panel, results, chosen, overlays)
    some = spark.createDataFrame([("candidate", days[0])], "kind string, as_of date").unionByName(panel.select(F.lit("factor").alias("kind"), "as_of").distinct())
    assert {r.intent_id: r.candidate_status for r in trades.context(intents, panel, results, chosen, overlays, some).collect()}[1] == "not_selected"


def test_volume_falls_back_to_the_overlay(spark):
    evidence = spark.createDataFrame([(1, 0.1, 0.1, 0.4, 0.1), (2, 0.1, 0.1, None, 0.1), (3, 0.1, 0.1, None, 0.1)], "entity long, ret_20d double, ret_60d double, volume_ratio double, relative_strength double")
    none = spark.createDataFrame([], "entity long, strategy string, rank_percentile double, validation string, entry double, stop double, target double, confirmed boolean")
    overlays = spark.createDataFrame([(1, 0.9), (2, 1.9)], "entity long, volume_ratio_now double")
    rows = decisions.swing_ratios(evidence, none, none, none, none, overlays).select("entity", "volume_confirmation").collect()
    assert {r.entity: r.volume_confirmation for r in rows} == {1: 0.4, 2: 1.0, 3: None}


def test_references_of_trades(spark):
    evaluations = spark.createDataFrame([("e1", "PASS", 0.5), ("e2", "WAIT", 0.5)], "id string, decision string, proposed double")
    good = ("e1", "r", ["x"], "s", True, 3, 0.4)
    odd = {"gone": ("e9", *good[1:]), "equal": (*good[:6], 0.5), "below": (*good[:6], -0.1), "nothing": ("e1", " ", [], None, None, 11, None)}
    overrides = spark.createDataFrame([("ok", *good), *[(k, *v) for k, v in odd.items()]], "id string, evaluation_id string, reason string, evidence array<string>, stop_rule string, acknowledged boolean, fomo int, cap double")
    found = sorted((r.id, r.rule, r.refers_to) for r in trades.override_findings(overrides, evaluations).collect())
    assert found == [("below", "CAP", "e1"), ("equal", "CAP", "e1"), ("gone", "EVALUATION", "e9")] + [("nothing", r, "e1") for r in ("CAP", "EVIDENCE", "FOMO", "NOT_ACKNOWLEDGED", "REASON", "STOP")]
    plans = spark.createDataFrame([("p1", "e1"), ("p2", "e2")], "id string, evaluation_id string")
    done = [
        ("x1", "e1", "p1", None, 1.0, 1), ("x2", "e1", "p2", None, 1.0, 1), ("x3", "e2", "p2", None, 1.0, 1), ("x4", "e1", None, "ok", 1.0, 1), ("x5", "e2", None, "ok", 1.0, 1), ("x6", "e1", "p1", "ok", 0.0, 1),
        ("x7", "e1", None, None, 1.0, None), ("x8", "e9", "p9", None, 1.0, 1),
    ]
    executions = spark.createDataFrame(done, "id string, evaluation_id string, plan_id string, override_id string, price double, quantity int")
    found = sorted((r.id, r.rule, r.refers_to) for r in trades.execution_findings(executions, evaluations, plans, overrides).collect())
    assert found == [
        ("x2", "PLAN", "p2"), ("x3", "NOT_PASSED", "e2"), ("x5", "OVERRIDE", "ok"), ("x6", "FILL", "e1"), ("x6", "ONE_OF", "e1"), ("x7", "FILL", "e1"), ("x7", "ONE_OF", "e1"), ("x8", "EVALUATION", "e9"), ("x8", "PLAN", "p9"),
    ]


def test_kinds_that_a_day_lacks(spark):
    written = spark.createDataFrame([("a", DAY), ("b", DAY), ("a", DAY), ("x", DAY), ("a", DAY + dt.timedelta(days=1))], "kind string, day date")
    log = spark.createDataFrame([(DAY, "s", "SUCCESS"), (DAY + dt.timedelta(days=2), "t", "BLOCKED"), (DAY + dt.timedelta(days=2), "s", "FAILED")], "day date, stage string, status string")
    rows = [tuple(r)[1:] for r in lifecycle.snapshot_report(written, ["b", "a"], log).orderBy("day").collect()]
    assert rows == [(["a", "b"], [], [], [], True), (["a"], ["b"], [], [], False), ([], ["a", "b"], ["t"], ["s"], False)]


def test_a_late_row_stops_the_write(spark, tmp_path):
    at = dt.datetime(2020, 1, 2, 7)
    rows = spark.createDataFrame([(1, at, "2020-01-02T15:00:00+08:00"), (2, at + dt.timedelta(seconds=1), "2020-01-02 07:00:00Z")], "k long, at timestamp, said string")
    moment = "2020-01-02T15:00:00+08:00"
    with pytest.raises(Exception, match="2 2020-01-02 07:00:01: known after"):
        gates.known_at(rows, moment, "at", ["k"]).select("said").write.parquet(str(tmp_path / "t"))
    assert gates.known_at(rows.where("k = 1"), moment, "at", ["k"]).count() == 1 and gates.known_at(rows, moment, "said", ["k"]).count() == 2
    for bad, why in (("2020-01-02 07:00:00", "without a zone"), ("x+08:00", "not a time"), (None, "not a time")):
        with pytest.raises(Exception, match=why):
            gates.known_at(rows.withColumn("said", F.lit(bad).cast("string")), moment, "said", ["k"]).collect()
    for at_, column in (("2020-01-02 15:00:00", "at"), (moment, "day")):
        with pytest.raises(ValueError):
            gates.known_at(rows.withColumn("day", F.to_date("at")), at_, column, ["k"])


def test_bundle_names_what_never_landed(spark, tmp_path):
    root, metrics = f"file://{tmp_path}", {"roe": ("roe_ttm", "%")}
    with pytest.raises(FileNotFoundError):
        bundle.assemble(spark, root, "2020-12-31 00:00:00+00:00", {})
    bars = [(1, "7", "2020-01-02", "1", "1", "1", "5", "9", "9"), (2, "7", "2020-01-03", "1", "1", "1", "-5", "9", "9"), (3, "7", "2021-01-03", "1", "1", "1", "5", "9", "9"), (4, "", "2020-01-03", "1", "1", "1", "5", "9", "9")]
    spark.createDataFrame(bars, "row long, entity string, trade_date string, open string, high string, low string, close string, volume string, amount string").write.parquet(f"{root}/bars.parquet")
    rows = spark.createDataFrame([(1, "7", "2020-03-31", "2020-04-30", "5"), (2, "7", "2020-06-30", "2021-04-30", "6"), (3, "7", "2020-03-31", "bad", "6")], "row long, entity string, report_period string, announce_date string, roe string")
    rows.write.parquet(f"{root}/income.parquet")
    rows.where("row = 2").write.parquet(f"{root}/balance.parquet")
    rows.limit(0).write.parquet(f"{root}/cash.parquet")
    b = bundle.assemble(spark, root, "2020-12-31 00:00:00+00:00", {k: metrics for k in ("income", "balance", "cash", "other")})
    assert b.absent == ("securities", "cash", "other") and b.securities is None
    assert [r.close for r in b.bars.collect()] == [5.0] and [r.rule for r in b.issues.collect()] == ["close_not_positive"]
    assert [(r.dataset, r.value) for r in b.observations.collect()] == [("income", 5.0)]
    assert {r.dataset: r.n for r in b.pending.collect()} == {"income": 1, "balance": 1}
    assert sorted((r.dataset, r.row, r.column) for r in b.failures.collect()) == [("bars", 4, "key"), ("income", 3, "announce_date")]


def test_nearest_days_over_a_long_closure(spark):
    trading = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 2),), (dt.date(2020, 9, 1),)], "day date")
    asked = spark.createDataFrame([(dt.date(2019, 12, 1),), (dt.date(2020, 1, 1),), (dt.date(2020, 5, 5),), (dt.date(2020, 5, 5),), (dt.date(2021, 1, 1),)], "day date")
    got = [tuple(r) for r in lifecycle.nearest_days(asked, trading).orderBy("day").collect()]
    first, second, last = (r.day for r in trading.collect())
    assert got == [(dt.date(2019, 12, 1), None, first), (first, first, second), (dt.date(2020, 5, 5), second, last), (dt.date(2021, 1, 1), last, None)]
