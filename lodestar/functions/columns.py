"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.tables import settle

VALUE, NULL, STALE, INVALID, SOURCE_ERROR, NOT_APPLICABLE = "VALUE", "NULL", "STALE", "INVALID", "SOURCE_ERROR", "NOT_APPLICABLE"

#: Cells that mean no value.
ABSENT = ("", "-", "--", "n/a", "na", "none", "null", "nan")


def visible(df: DataFrame, as_of: str, column: str) -> DataFrame:
    """Rows known at as_of: column not later."""
    return df.where(F.col(column) <= F.lit(as_of).cast("date"))


def exact_sum(column: Column, scale: int = 4) -> Column:
    """A sum of doubles of few decimals that does not depend on the order of rows."""
    return F.sum(column.cast(f"decimal(18,{scale})")).cast("double")


def tally(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, ties, before, n: each distinct value with its rows, the rows of smaller values and all rows with a value in its group.

    Equal values are counted before the shuffle; the counts are dealt by range of
    (keys, value), and each part adds the sums of the parts before it, so no task
    holds a group.  Rows without a value do not count; keys are never null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    cut = settle(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "tally")
    group, within = Window.partitionBy(*keys), Window.partitionBy(*keys, "_part")
    start, last = Window.unboundedPreceding, -1
    so_far = lambda c, over, order: F.coalesce(F.sum(c).over(over.orderBy(order).rowsBetween(start, last)), F.lit(0))
    # a row for each group and part
    sums = cut.groupBy(*keys, "_part").agg(F.sum("ties").alias("_sum"))
    parts = sums.select(*keys, "_part", so_far("_sum", group, "_part").alias("_before"), F.sum("_sum").over(group).alias("n"))
    return cut.join(parts, [*keys, "_part"]).select(*keys, value, "ties", (F.col("_before") + so_far("ties", within, value)).alias("before"), "n")


def with_percentile(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with name, the average rank of ties over the number of values in the group, in (0, 1], to 12 places; null without a value.

    df is read twice, so settle what is dear.
    """
    share = F.round((F.col("before") + 1 + (F.col("ties") - 1) / 2) / F.col("n"), 12)
    return df.join(tally(df, keys, value).select(*keys, value, share.alias(name)), [*keys, value], "left")


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """For each group the values at the given places, from 0, of its n ordered values."""
    held = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("ties"))
    return tally(df, keys, value).groupBy(*keys).agg(*[F.max(F.when(held(place), F.col(value))).alias(name) for name, place in places.items()])


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """For each group the values at place round-half-even(f * (n - 1)), without interpolation."""
    return at_places(df, keys, value, {name: F.bround(F.lit(f) * (F.col("n") - 1)).cast("long") for name, f in fractions.items()})


def classify(cell: Column) -> tuple[Column, Column]:
    """A text cell as (number or null, reason of failure or null)."""
    plain = F.lower(F.trim(cell))
    absent = cell.isNull() | plain.isin(*ABSENT)
    number = F.trim(cell).try_cast("double")
    finite = F.abs(number) < F.lit(float("inf"))  # not so for NaN, which is above all
    value = F.when(~absent & finite, number)
    reason = F.when(absent, None).when(number.isNull(), "unparsable").when(~finite, "not_finite")
    return value, reason


def fail_if_any(df: DataFrame, message: str, first: int = 5) -> None:
    """Raise with the first offenders if df has rows."""
    found = df.limit(first).collect()
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")
