"""State events, run logs and the trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The path of states and those that may not be entered.
PATH = ("signup", "view", "click", "purchase")
RESERVED = ("error",)
TERMINAL = ("SUCCESS", "FAILED", "BLOCKED")


def _accepted(events: DataFrame) -> DataFrame:
    """entity and at_0, at_1, ..: struct(order, ts) of the event that entered each state of the path, null if none did.

    A state is entered by the first event after the one before it, in the order of
    recording, that is not earlier than that one.  So each is a minimum, combined before the shuffle.
    """
    found = events.select("entity").distinct()
    for n, state in enumerate(PATH):
        rows = events.where(F.col("state") == state)
        if n:
            last = F.col(f"at_{n - 1}")
            rows = rows.join(found.select("entity", f"at_{n - 1}"), "entity").where((F.col("order") > last["order"]) & (F.col("ts") >= last["ts"]))
        found = found.join(rows.groupBy("entity").agg(F.min(F.struct("order", "ts")).alias(f"at_{n}")), "entity", "left")
    return found


def transitions(events: DataFrame) -> DataFrame:
    """entity, event_id, ts, state, held, verdict, refusal: each event, in the order of its id, against the state held then.

    A refused event changes nothing.  held is null before the first state.  Rules in
    order: earlier than the last change; a reserved state; the end of the path; not the next state.
    """
    rows = events.withColumn("order", F.col("event_id"))
    joined = rows.join(_accepted(rows), "entity")
    entered = F.array_compact(F.array(*[F.when(F.col(f"at_{n}.order") < F.col("order"), F.struct(F.lit(s).alias("state"), F.col(f"at_{n}.ts").alias("ts"))) for n, s in enumerate(PATH)]))
    joined = joined.withColumn("_steps", F.size(entered)).withColumn("_last", F.try_element_at(entered, F.lit(-1)))
    path = F.array(*[F.lit(s) for s in PATH])
    following, held = F.get(path, F.col("_steps")), F.col("_last.state")
    verdict = (
        F.when(F.col("ts") < F.col("_last.ts"), "BACKWARDS").when(F.col("state").isin(*RESERVED), "RESERVED").when(F.col("_steps") == len(PATH), "AT_END")
        .when(F.col("state") == following, "ACCEPTED").when(F.col("_steps") == 0, "NOT_FIRST").otherwise("NOT_NEXT")
    )
    told = F.concat(F.col("entity").cast("string"), F.lit(" cannot move to "), F.coalesce("state", F.lit("nothing")), F.lit(": "))
    why = (
        F.when(F.col("verdict") == "BACKWARDS", F.lit("its last change is later")).when(F.col("verdict") == "RESERVED", F.lit("a reserved state"))
        .when(F.col("verdict") == "AT_END", F.concat(held, F.lit(" ends the path"))).otherwise(F.concat(F.lit("only "), following, F.lit(" follows "), F.coalesce(held, F.lit("nothing"))))
    )
    judged = joined.withColumn("verdict", verdict)
    return judged.select("entity", "event_id", "ts", "state", held.alias("held"), "verdict", F.when(F.col("verdict") != "ACCEPTED", F.concat(told, why)).alias("refusal"))


def fold_states(events: DataFrame) -> DataFrame:
    """entity, state, steps: the state after all events, in order of time, that were the next on the path from the state then held; others change nothing."""
    found = _accepted(events.withColumn("order", F.struct("ts", "event_id")))
    steps = sum((F.col(f"at_{n}").isNotNull().cast("bigint") for n in range(len(PATH))), F.lit(0).cast("bigint"))
    return found.select("entity", F.get(F.array(*[F.lit(s) for s in PATH]), (steps - 1).cast("int")).alias("state"), steps.alias("steps"))


def run_violations(log: DataFrame) -> DataFrame:
    """run_id, rule: finished exactly if terminal, an error exactly if failed or blocked."""
    ended, wrong = F.col("status").isin(*TERMINAL), F.col("status").isin("FAILED", "BLOCKED")
    found = F.array_compact(F.array(F.when(F.col("finished_at").isNotNull() != ended, "FINISHED"), F.when(F.col("error").isNotNull() != wrong, "ERROR")))
    return log.select("run_id", F.explode(found).alias("rule"))


def roll_up(log: DataFrame) -> DataFrame:
    """day, failed, blocked, complete."""
    return log.groupBy("day").agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"), F.bool_and(F.col("status") == "SUCCESS").alias("complete"))


def snapshot_report(written: DataFrame, kinds: list[str], log: DataFrame) -> DataFrame:
    """day, written, missing, blocked, failed, complete: the kinds of snapshots that each day of the log has and lacks, in order, and the stages that stopped.

    written: kind, day; kinds is the fixed list of all.  log: day, stage, status.  A day that
    only written has is told too.  complete: nothing is missing and each run succeeded.
    """
    there = written.where(F.col("kind").isin(*kinds)).groupBy("day").agg(F.sort_array(F.collect_set("kind")).alias("written"))
    stopped = lambda s: F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("stage"))))
    ran = log.groupBy("day").agg(stopped("BLOCKED").alias("blocked"), stopped("FAILED").alias("failed"), F.bool_and(F.col("status") == "SUCCESS").alias("_fine"))
    none = F.array().cast("array<string>")
    rows = ran.join(there, "day", "full_outer").withColumns({c: F.coalesce(c, none) for c in ("written", "blocked", "failed")})
    rows = rows.withColumn("missing", F.array_except(F.sort_array(F.array(*[F.lit(k) for k in kinds])), "written"))
    return rows.select("day", "written", "missing", "blocked", "failed", (F.coalesce("_fine", F.lit(False)) & (F.size("missing") == 0)).alias("complete"))


def calendar(spark: SparkSession, first: str, last: str, holidays: tuple[str, ...] = ()) -> DataFrame:
    """day of each trading day: weekdays that are no holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where((F.weekday("day") < 5) & ~F.col("day").isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.weekday("day") < 5)


def nearest_days(dates: DataFrame, trading: DataFrame) -> DataFrame:
    """day, latest, following: the latest trading day not after each date, and the first after it, however long a closure is.

    Both are sets of days, so all rows of the one window are as many as a calendar has.
    """
    asked = dates.select("day").distinct().select("day", F.lit(None).cast("date").alias("t"), F.lit(True).alias("asked"))
    marks = trading.select("day").distinct().select("day", F.col("day").alias("t"), F.lit(False).alias("asked"))
    order = Window.orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long"))
    latest = F.max("t").over(order.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min("t").over(order.rangeBetween(1, Window.unboundedFollowing))
    both = asked.unionByName(marks).withColumns({"latest": latest, "following": following})
    return both.where("asked").select("day", "latest", "following")
