"""Registered queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

from millrace.plans import access, artifacts, control, documents, events, evidence, integrity, packages, parsing, retrieval, search

_PLANS = (access, documents, artifacts, retrieval, control, integrity, events, evidence, packages, parsing, search)

QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
