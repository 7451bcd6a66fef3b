"""Where queries register, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.plans.fixtures import VIEWS, Views, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the derived tables that a text names in front of it."""
    used = [v for v in VIEWS if f" {v} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    if not used:
        return sql
    head = "WITH " + ", ".join(f"{v} AS ({duck(v)})" for v in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]}, {body[15:]}"
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"


def query(sql: str | None = None):
    """Register the decorated function of the views under its own name."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[fn.__name__] = with_views(sql)
        return fn

    return register
