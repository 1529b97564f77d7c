"""Every registered query and its SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "hybrid_retrieve"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_ALL: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: registers a query under ``name`` with the SQL that it is compared with."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in _ALL:
            raise ValueError(f"{name} is registered twice")
        _ALL[name] = Query(f, sql)
        return f

    return wrap


def _load() -> None:
    """Imports the plan modules, which register themselves."""
    from docquarry.plans import analytics_plans, backtest_plans, chunking_plans, grounding_plans, ledger_plans, retrieval_plans, shape_plans, statement_plans, text_plans, worker_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.run for k, q in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in _ALL.items() if q.sql}
