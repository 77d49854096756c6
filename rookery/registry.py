"""Every query of the library by name, with its DuckDB oracle where SQL can express it.

An operator is a function of DataFrames; ``query`` binds it to tables or views (see plans/views.py) by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Register an operator under ``name``, applied to the named tables or views; ``sql``: the same rows in DuckDB."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(views.load(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    """DuckDB SQL preceded by the views it uses."""
    used = sorted(set(re.findall(r"\bv_\w+", sql)) & set(views.DUCKDB))
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS ({views.DUCKDB[v]})" for v in used)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else ""
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql) if re.match(r"\s*WITH\b", sql) else " " + sql
    return f"WITH {recursive}{ctes}{rest}"
