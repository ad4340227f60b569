"""Rows of two results in a form that compares."""

from __future__ import annotations

import math


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        return int(v) if hasattr(v, "__index__") else v

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)
