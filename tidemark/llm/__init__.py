"""Operators for building training corpora.

Nothing else in the library imports this subpackage. ``queries()`` and ``oracle_sql()`` gather what the
modules named in ``MODULES`` register as ``QUERIES`` and ``ORACLE``.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "quality", "toxicity", "decontamination", "tokens", "jaccard", "sanitisation", "extraction", "neighbours", "warc", "phrases", "merkle", "sharding")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tidemark.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"tidemark.llm.{m}"), "ORACLE", {}).items()}
