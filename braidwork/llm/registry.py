"""The subpackage's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "chat", "divergence", "fingerprints", "media", "mixing", "pii", "quality", "secrets", "simhash", "snapshots", "token_counts", "toxicity")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"braidwork.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        module = import_module(f"braidwork.llm.{m}")
        out |= module.oracle() if hasattr(module, "oracle") else {}
    return out
