"""Operators of a large-scale training-data pipeline; nothing else in the library imports them."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Workers get these functions by value, so they need not find the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Modules with QUERIES and ORACLE_SQL, by number of operator.
MODULES = ("embeddings", "minhash", "mixing", "suffixes", "quality", "fingerprints", "urls", "records", "toxicity", "bpe", "words", "divergence", "conversations")


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
