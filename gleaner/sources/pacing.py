"""Rates of calls by API key: token buckets, and pauses that a service asks for."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from email.utils import parsedate_to_datetime


def seconds_of(header: str | None, now: float) -> float | None:
    """A Retry-After header, seconds or a date, as seconds from now; None where it says nothing."""
    if not (header or "").strip():
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except (TypeError, ValueError):
        return None


class Pace:
    """Admits calls for each key at `requests` and `tokens` a minute, divided by `shares`, the partitions that call at once.

    A bucket holds what a minute's share allows at most, so a partition starts with a burst of that. Executors share
    no memory: dividing the rates is what keeps all partitions together below them. A key that a service told to wait
    isn't used until then; others go on.
    """

    def __init__(self, requests: float | None = None, tokens: float | None = None, shares: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rates = [None if r is None else max(r / max(1, shares), 1e-9) for r in (requests, tokens)]
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.held: dict[str, list[float]] = {}
        self.seen: dict[str, float] = {}
        self.closed: dict[str, float] = {}

    def _wait(self, key: str, cost: tuple[float, float], now: float) -> float:
        """Seconds until the key's buckets hold the cost (a cost above a whole bucket: until it is full)."""
        past = now - self.seen.get(key, now)
        held = self.held.setdefault(key, [max(r, 1.0) if r else 0.0 for r in self.rates])
        wait = self.closed.get(key, now) - now
        for i, rate in enumerate(self.rates):
            if rate is not None:
                held[i] = min(max(rate, 1.0), held[i] + past * rate / 60)
                wait = max(wait, (min(cost[i], max(rate, 1.0)) - held[i]) * 60 / rate)
        self.seen[key] = now
        return max(0.0, wait)

    def take(self, keys: Sequence[str], turn: int, tokens: int = 0) -> str:
        """The first of keys, from turn on, that is free; waits for the one that is free soonest."""
        while True:
            with self.lock:
                now = self.clock()
                order = [keys[(turn + i) % len(keys)] for i in range(len(keys))]
                waits = [self._wait(k, (1, tokens), now) for k in order]
                soonest = min(range(len(order)), key=lambda i: waits[i])
                if waits[soonest] <= 1e-9:
                    for i, rate in enumerate(self.rates):
                        if rate is not None:
                            self.held[order[soonest]][i] -= (1, tokens)[i]
                    return order[soonest]
            self.sleep(waits[soonest])

    def block(self, key: str, seconds: float) -> None:
        with self.lock:
            self.closed[key] = max(self.closed.get(key, 0.0), self.clock() + seconds)
