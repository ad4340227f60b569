"""Settings, with the defaults that code and not documents name."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from .errors import LoadError


@dataclass(frozen=True)
class Settings:
    parent_tokens: int = 3500
    child_tokens: int = 300
    overlap_tokens: int = 35
    dense_weight: float = 0.4
    bm25_weight: float = 0.3
    graph_weight: float = 0.3
    pool: int = 40
    final_top_k: int = 15
    near_tie_gap: float = 0.02
    near_tie_extra: int = 20
    duplicate_threshold: float = 0.75
    grounded: float = 0.65
    partial: float = 0.45
    well_grounded: float = 0.7
    hub_degree: int = 100
    max_hops: int = 2
    probes: int = 0
    rrf_k: int = 60
    variants: int = 4
    fused_cap: int = 30
    per_channel: int = 15
    edge_kinds: tuple[str, ...] | None = None

    @classmethod
    def load(cls, *paths: str | None, **overrides) -> Settings:
        """Defaults, then JSON files in order, of which a later one holds, then ``overrides``; an unknown name is an error. A file's ``defaults``, a list of
        names of files beside it, come before its own values."""
        given = {}
        for path in paths:
            given |= _composed(path, ()) if path else {}
        given |= overrides
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise LoadError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **given)


def _composed(path: str, above: tuple[str, ...]) -> dict:
    """The values of a file over those of the files that it names."""
    path = os.path.abspath(path)
    if path in above:
        raise LoadError(f"{path} names itself as a default")
    try:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
    except (OSError, ValueError) as e:
        raise LoadError(f"{path} can't be read: {e}") from e
    out = {}
    for name in own.pop("defaults", []):
        out |= _composed(os.path.join(os.path.dirname(path), name), (*above, path))
    return out | own


def first_existing(paths: Iterable[str]) -> str:
    """The first of some places of a file that exists."""
    for p in paths:
        if os.path.exists(p):
            return p
    raise LoadError("none of the places has the file")
