"""Queries by name: a function of the tables, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strikeline.plans.fixtures import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """sql may begin with WITH; the tables of the fixtures are there by name."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
    if sql is not None:
        sql = sql.strip()
        first = "WITH RECURSIVE" if sql.upper().startswith("WITH RECURSIVE ") else "WITH"
        ORACLE[name] = f"{first} {SQL.strip()}" + (f", {sql[len(first) + 1:]}" if sql.upper().startswith("WITH ") else f"\n{sql}")
