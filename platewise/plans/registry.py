"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MACROS = ("kcal", "protein", "fat", "carbs")


def register(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that DuckDB runs for it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def with_views(sql: str, **more: str) -> str:
    """SQL with the stand-in views in front."""
    views = {"foods": v.CATALOGUE_SQL, "diary": v.DIARY_SQL, "goals": v.GOALS_SQL, "weights": v.WEIGHTS_SQL, "profiles": v.PROFILES_SQL, "long_values": v.LONG_SQL} | more
    used = {n: q for n, q in views.items() if n in sql or any(n in x for x in more.values())}
    return "with " + ", ".join(f"{n} as ({q})" for n, q in used.items()) + " " + sql
