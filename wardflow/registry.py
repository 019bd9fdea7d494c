"""All queries of the library by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("plans.attendance", "plans.money", "plans.liabilities", "plans.opening", "plans.records", "operators.ledger", "operators.intervals", "operators.admission", "operators.relational", "operators.cleaning", "operators.text", "operators.sentence_spans", "operators.figures", "operators.repeats", "operators.statements", "operators.classify", "operators.conditions", "operators.record_checks", "operators.imports", "operators.paging", "functions.scalars", "functions.calendar", "streaming.jobs", "streaming.sweeps", "streaming.steps", "sources.episodes", "sources.printed")
_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"wardflow.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
