"""A cache at the driver for results of single questions: least recently used, with an expiry."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable


class Cache:
    def __init__(self, size: int = 256, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    @staticmethod
    def key(query: str) -> str:
        return hashlib.sha256(query.strip().lower().encode()).hexdigest()

    def get(self, query: str):
        """What is held, or None; None itself is never held."""
        key = self.key(query)
        if key not in self.held:
            return None
        at, value = self.held[key]
        if self.clock() - at > self.seconds:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return value

    def put(self, query: str, value) -> None:
        if value is None:
            return
        self.held[self.key(query)] = (self.clock(), value)
        self.held.move_to_end(self.key(query))
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def call(self, query: str, make: Callable[[str], object]):
        got = self.get(query)
        if got is None:
            got = make(query)
            self.put(query, got)
        return got
