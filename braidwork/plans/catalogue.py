"""Named queries over the test tables, each with its SQL for comparison."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("series", "swings", "corpus", "league", "records", "search", "flows", "ledger", "notes")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"braidwork.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"braidwork.plans.{m}").ORACLE.items()}
