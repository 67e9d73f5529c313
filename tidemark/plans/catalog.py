"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from tidemark.plans import checks, ingestion, monitoring, orders, tables

_PLANS = (orders, monitoring, checks, ingestion, tables)

QUERIES = {k: f for plan in _PLANS for k, f in plan.QUERIES.items()}
ORACLE = {k: s for plan in _PLANS for k, s in plan.ORACLE.items()}
