"""Registered queries, by family."""

from __future__ import annotations

import importlib

FAMILIES = ("retrieval", "documents", "knowledge", "answers", "evaluation", "indexes", "generation")


def _all(name: str) -> dict:
    return {k: v for f in FAMILIES for k, v in getattr(importlib.import_module(f"{__name__}.{f}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
