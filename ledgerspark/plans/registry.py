"""All registered queries of the library, by name: query(name, view, sql) marks a function of the view's DataFrame."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from .demo_views import oracle, view

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
SECTIONS = ["q_ledger", "q_gates", "q_validate", "q_cells", "q_resolve", "q_facts", "q_provenance", "q_contacts", "q_corpus", "q_retrieve", "q_ground", "q_watch", "q_io"]


def query(name: str, *views: str, sql: str | None = None):
    """Register f(view DataFrames...) as a query over a folder of tables."""

    def mark(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            _SQL[name] = oracle(sql)
        return f

    return mark


def _load() -> None:
    for section in SECTIONS:
        if importlib.util.find_spec(f"ledgerspark.plans.{section}"):
            importlib.import_module(f"ledgerspark.plans.{section}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
