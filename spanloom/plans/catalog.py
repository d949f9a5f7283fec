"""Registry of the queries: name -> (function, oracle SQL or None, ids of the survey's operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("retrieval", "store", "aggregates", "scalars", "graphs", "texts", "extras", "composed", "incremental", "surface", "work")
_REGISTRY: dict[str, tuple[Query, str | None, tuple[str, ...]]] = {}


def register(name: str, survey: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = (f, sql, tuple(survey.split()))
        return f

    return wrap


def _load() -> None:
    import importlib

    for m in MODULES:
        importlib.import_module(f"spanloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1]}


def survey_ids() -> dict[str, tuple[str, ...]]:
    _load()
    return {k: v[2] for k, v in _REGISTRY.items()}
