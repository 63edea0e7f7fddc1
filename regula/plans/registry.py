"""Registry of named queries (operator bound to the role views) and their
independent SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; Spark's returns BIGINT.  Rewrite
    ``count_if(p)`` as ``count(CASE WHEN p THEN 1 END)`` (BIGINT) so both
    sides agree on the type."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _bigint_count_if(sql[j + len(tok):k - 1])
        out.append(sql[i:j] + f"count(CASE WHEN {inner} THEN 1 END)")
        i = k


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``sql`` is the DuckDB oracle; omit it only for operators that SQL cannot
    express (iterative models, sampling-based algorithms)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = _bigint_count_if(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from regula.plans import (  # noqa: F401
        q_reports,
        q_relational,
        q_timeseries,
        q_stats,
        q_profile,
        q_prescriptive,
        q_ml_tables,
        q_models,
    )
