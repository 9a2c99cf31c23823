"""Catalogue of queries over the shared test tables, each with an independent ANSI SQL form where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a plan under its function name, with its SQL form."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in CATALOGUE:
            raise ValueError(f"duplicate query {key}")
        CATALOGUE[key] = Query(key, plan, sql)
        return plan

    return add
