"""Registration of queries over a Day, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestar.plans.day import Day
from lodestar.plans.oracles import sql


class Register:
    """A decorator that registers a function of a Day under a name; None stands for no oracle."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None) -> Callable:
        def wrap(f: Callable[[Day], DataFrame]) -> Callable[[Day], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: f(Day.of(spark, sf_dir))
            if oracle is not None:
                self.oracles[name] = sql(oracle)
            return f

        return wrap
