"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from . import analysis, evidence, retrieval, texts

PARTS = (retrieval, texts, analysis, evidence)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}
