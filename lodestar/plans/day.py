"""A day end to end: bars and observations to factors, scores, qualifications, market context and candidates."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.tables import settle
from lodestar.operators import candidates, factors, lineage, market, qualify, scoring, universe
from lodestar.plans import testbed

#: Limits for the testbed's scale of amounts.
FLOOR, VETO_BELOW, PLENTY = 50_000.0, 52_000.0, 60_000.0
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
LIMITS = {"exchanges": ("AFRICA", "AMERICA", "ASIA", "EUROPE"), "least_days": 365, "most_suspended": 30}


class Day:
    """The stages of one as_of; each is a DataFrame, and those that others use again are settled once.

    of() gives one Day to all queries of an application over the same tables, so
    that they share its settled stages.
    """

    _held: dict[tuple, Day] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Day:
        key = spark.sparkContext.applicationId, sf_dir
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(spark, sf_dir)
        return cls._held[key]

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = testbed.AS_OF):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, as_of
        # the JVM never compiles a longer method; where whole-stage code has one, Spark then runs its operators one by one
        if spark.conf.get(METHOD_LIMIT) == "65535":  # Spark's own default
            spark.conf.set(METHOD_LIMIT, "8000")

    def view(self, name: str) -> DataFrame:
        """A view; those that build on bars read the settled ones where there are any."""
        held = {"bars": self.bars} if name != "bars" and "bars" in self.__dict__ else {}
        return testbed.view(self.spark, self.sf_dir, name, held)

    def by_entity(self, name: str) -> DataFrame:
        """A view of lines with all lines of an entity in one partition, so that a grouping by entity shuffles nothing more. Few bars have two lines, so lines are not combined before their shuffle."""
        return testbed.view(self.spark, self.sf_dir, name, {"lineitem": self.view("lineitem").repartition("l_suppkey")})

    @property
    def bars_by_entity(self) -> DataFrame:
        return self.by_entity("bars")

    @cached_property
    def bars(self) -> DataFrame:
        return settle(self.view("bars"), "bars")

    @cached_property
    def line(self) -> DataFrame:
        """The line view with its rounded columns made once, not anew in each expression that reads them."""
        return settle(self.view("line"), "line")

    @cached_property
    def panel(self) -> DataFrame:
        bars = self.bars
        return settle(factors.panel(bars, self.view("statements_wide"), self.view("valuations_wide"), self.view("dividends"), self.as_of, self.price_panel), "panel")

    @cached_property
    def price_panel(self) -> DataFrame:
        return settle(factors.price_factors(self.bars, self.as_of), "price_panel")

    @cached_property
    def universe(self) -> DataFrame:
        bars = self.bars
        return settle(universe.build(self.view("securities"), bars, self.price_panel, self.as_of, floor=FLOOR, **LIMITS), "universe")

    @cached_property
    def members(self) -> DataFrame:
        return self.universe.where("included").select("entity")

    @cached_property
    def weights(self) -> DataFrame:
        return scoring.spec(self.spark)

    @cached_property
    def limits(self) -> DataFrame:
        return qualify.thresholds(self.spark)

    @cached_property
    def results(self) -> DataFrame:
        return settle(scoring.results(self.panel, self.weights, self.members), "results")

    @cached_property
    def cited(self) -> DataFrame:
        """results with the factors that they rest on, and versions."""
        return settle(lineage.cite_factors(self.results, self.panel, self.weights), "cited")

    @cached_property
    def published(self) -> DataFrame:
        """The candidates with their citations and lineage, as they are stored."""
        return settle(lineage.cite_results(self.candidates, self.qualified, self.cited), "published")

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score(self.panel.join(self.members, "entity", "left_semi"), self.weights)

    @cached_property
    def qualified(self) -> DataFrame:
        return settle(qualify.qualify(self.results, self.panel, self.limits, least=0.75), "qualified")

    @cached_property
    def evidence(self) -> DataFrame:
        bars = self.bars
        return settle(market.evidence(self.panel, bars, self.view("industry"), self.view("benchmark_bars"), self.as_of), "evidence")

    @cached_property
    def validated(self) -> DataFrame:
        rows = qualify.primary(self.qualified).join(self.evidence, "entity")
        checked = market.validate(rows, veto_below=VETO_BELOW, plenty=PLENTY)
        return settle(checked.withColumn("signal", market.signal(checked["strategy"])), "validated")

    @cached_property
    def assembled(self) -> DataFrame:
        return settle(candidates.assemble(self.qualified, self.validated), "assembled")

    @cached_property
    def candidates(self) -> DataFrame:
        return settle(candidates.build(candidates.select(self.assembled, self.qualified, each=2, cap=12)), "candidates")

    @cached_property
    def regime(self) -> DataFrame:
        bars = self.bars
        return market.regime(market.breadth(bars, self.as_of), market.benchmark_evidence(self.view("benchmark_bars"), self.as_of))
