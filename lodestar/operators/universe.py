"""Population rules: which entities may be scored, with every rule that an entity fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.tables import settle
from lodestar.functions.columns import VALUE, visible

#: Rules in the order in which failures are reported.
LISTING_RULES = ("EXCHANGE", "ST", "DELISTING", "SUSPENDED", "LISTING_AGE")


def rules(as_of: str, *, exchanges: tuple[str, ...], least_days: int, most_suspended: int | None) -> dict[str, Column]:
    """Name of each listing rule and when an entity fails it; a rule over an unknown value does not fail."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("list_date"))
    long = F.lit(False) if most_suspended is None else F.coalesce(F.col("suspended_days") > most_suspended, F.lit(False))
    return {
        "EXCHANGE": ~F.col("exchange").isin(*exchanges),
        "ST": F.col("is_st"),
        "DELISTING": F.col("is_delisting"),
        "SUSPENDED": long,
        "LISTING_AGE": F.coalesce(age < least_days, F.lit(False)),
    }


def failures(checks: dict[str, Column]) -> Column:
    """Names of the rules that fail, in declared order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


def prefilter(securities: DataFrame, as_of: str, **limits) -> DataFrame:
    """entity, failed: the listing rules only."""
    return securities.select("entity", failures(rules(as_of, **limits)).alias("failed"))


def target_date(bars: DataFrame, as_of: str) -> DataFrame:
    """One row: the latest date of a bar at as_of."""
    return visible(bars, as_of, "trade_date").agg(F.max("trade_date").alias("target"))


def traded(bars: DataFrame, as_of: str) -> DataFrame:
    """Entities with a bar on the target date."""
    return bars.join(F.broadcast(target_date(bars, as_of)), F.col("trade_date") == F.col("target"), "left_semi").select("entity").distinct()


def first_profiles(securities: DataFrame) -> DataFrame:
    """securities with duplicate: false on the first row of an entity, in the order of the column position, the row's place in the input, where there is one, then of name and list date."""
    order = Window.partitionBy("entity").orderBy(*(c for c in ("position", "name", "list_date") if c in securities.columns))
    return securities.withColumn("duplicate", F.row_number().over(order) > 1)


def build(securities: DataFrame, bars: DataFrame, panel: DataFrame, as_of: str, *, floor: float, **limits) -> DataFrame:
    """entity, failed, included: listing rules, market data, liquidity and duplicates for every entity of the listing."""
    liquidity = panel.where("factor = 'avg_amount_20d'").select("entity", F.col("status").alias("_s"), F.col("raw_value").alias("_v"))
    known = first_profiles(securities).join(traded(bars, as_of).withColumn("_traded", F.lit(True)), "entity", "left").join(liquidity, "entity", "left")
    checks = rules(as_of, **limits) | {
        "NO_MARKET_DATA": F.col("_traded").isNull(),
        "LOW_LIQUIDITY": (F.col("_s") == VALUE) & (F.col("_v") < floor),
        "NO_LIQUIDITY_MEASURE": F.coalesce(F.col("_s") != VALUE, F.lit(True)),
        "DUPLICATE": F.col("duplicate"),
    }
    failed = failures(checks)
    return known.select("entity", failed.alias("failed"), (F.size(failed) == 0).alias("included"))


def stride(population: DataFrame, every: int, limit: int, key: str = "entity") -> DataFrame:
    """Each every-th member by key, limit at most: a deterministic sample of a listing.

    The rank is the place in a sorted partition plus the rows of those before,
    so no task holds the whole listing.
    """
    ordered = population.select(key).distinct().orderBy(key).withColumn("_p", F.monotonically_increasing_id())
    ordered = settle(ordered, "stride")
    part = F.shiftright("_p", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_p").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return ordered.withColumn("_part", part).join(before, "_part").withColumn("rn", rank).where((F.col("rn") % every == 0) & (F.col("rn") < every * limit)).select(key, "rn")
