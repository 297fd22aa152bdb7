"""Queries by name, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.plans.inputs import PRELUDE, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of the inputs under its name. ``sql`` goes on after the common table expressions of the inputs."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = PRELUDE + sql
        return fn

    return register
