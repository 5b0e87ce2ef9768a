"""Named queries: a Spark plan over a table folder and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewatt.session import utc

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under `name`; the plan always runs in a UTC session."""

    def register(plan: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(utc(spark), folder)

        CATALOG[name] = Query(name, run, sql)
        return plan

    return register


def load_catalog() -> dict[str, Query]:
    from tidewatt.plans import (  # noqa: F401
        calendar_queries,
        diagnosis_queries,
        evaluation_queries,
        model_queries,
        panel_queries,
        source_queries,
        streaming_queries,
        weather_queries,
    )

    return CATALOG
