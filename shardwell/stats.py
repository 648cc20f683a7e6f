"""Call statistics by table and operation, and the settings for them."""

from __future__ import annotations

import functools
import math
import time
from collections import Counter
from dataclasses import dataclass, field, fields

from .errors import CfgError, StatsError

# Labels of operations; a batch or object call counts under its operation.
OPERATIONS = ("insert", "insert_many", "get", "replace", "replace_many", "update", "upsert", "upsert_many", "delete", "select", "truncate", "len", "count", "borders", "locate")


@dataclass(frozen=True)
class Settings:
    stats: bool = False
    stats_driver: str = "local"
    stats_quantiles: bool = False
    stats_quantile_tolerated_error: float = 1e-3
    stats_quantile_age_buckets_count: int = 2
    stats_quantile_max_age_time: float = 60

    def changed(self, **new) -> Settings:
        known = {f.name: f for f in fields(self)}
        for k, v in new.items():
            if k not in known:
                raise TypeError(f"unexpected option {k!r}")
            want = {"bool": bool, "str": str, "int": int, "float": (int, float)}[known[k].type]
            if not isinstance(v, want) or (isinstance(v, bool) and want is not bool):
                raise CfgError(f"{k} should be {known[k].type}")
        if new.get("stats_driver", self.stats_driver) not in ("local", "metrics"):
            raise CfgError("unsupported stats driver")
        return Settings(**{f.name: new.get(f.name, getattr(self, f.name)) for f in fields(self)})


class Quantiles:
    """Latencies of the last age buckets as counts by powers of a base near 1: every call counts, within the tolerated relative error."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.held = clock, {}

    def add(self, seconds: float, settings: Settings) -> None:
        turn = int(self.clock() // settings.stats_quantile_max_age_time)
        self.held.setdefault(turn, Counter())[math.ceil(math.log(max(seconds, 1e-9), self._base(settings)))] += 1
        for old in [t for t in self.held if t <= turn - settings.stats_quantile_age_buckets_count]:
            del self.held[old]

    @staticmethod
    def _base(settings: Settings) -> float:
        e = max(1e-6, settings.stats_quantile_tolerated_error)
        return (1 + e) / (1 - e)

    def of(self, share: float, settings: Settings) -> float:
        turn, all_ = int(self.clock() // settings.stats_quantile_max_age_time), Counter()
        for t, counts in self.held.items():
            if t > turn - settings.stats_quantile_age_buckets_count:
                all_.update(counts)
        rank, base = min(sum(all_.values()) - 1, int(share * sum(all_.values()))), self._base(settings)
        for k in sorted(all_):
            rank -= all_[k]
            if rank < 0:
                return 2 * base**k / (base + 1)
        return 0.0


@dataclass
class Times:
    count: int = 0
    time: float = 0.0
    recent: Quantiles = field(default_factory=Quantiles)

    def add(self, seconds: float, settings: Settings) -> None:
        self.count += 1
        self.time += seconds
        if settings.stats_driver == "metrics" and settings.stats_quantiles:
            self.recent.add(seconds, settings)

    def view(self, settings: Settings) -> dict:
        out = {"count": self.count, "time": self.time, "latency_average": self.time / self.count if self.count else 0}
        if settings.stats_driver == "metrics" and settings.stats_quantiles:
            out["latency_quantile_recent"] = self.recent.of(0.99, settings)
        out["latency"] = out.get("latency_quantile_recent", out["latency_average"])
        return out


class Stats:
    def __init__(self):
        self.settings = Settings()
        self.reset()

    def reset(self) -> None:
        self.calls: dict[str, dict[str, dict[str, Times]]] = {}
        self.details: dict[str, dict[str, int]] = {}

    def observe(self, space: str, operation: str, ok: bool, seconds: float) -> None:
        if not self.settings.stats:
            return
        self.calls.setdefault(space, {}).setdefault(operation, {"ok": Times(), "error": Times()})["ok" if ok else "error"].add(seconds, self.settings)

    def detail(self, space: str, **counts: int) -> None:
        """tuples_fetched: rows given out; tuples_lookup: rows that the scan's filters let through (no tree lookups exist here); map_reduces: reads of all shards."""
        if not self.settings.stats:
            return
        own = self.details.setdefault(space, {"map_reduces": 0, "tuples_fetched": 0, "tuples_lookup": 0})
        for k, v in counts.items():
            own[k] += v

    def view(self, space: str | None = None) -> dict:
        if space is not None and not isinstance(space, str):
            raise StatsError("space should be a name")
        one = lambda s: {op: {k: t.view(self.settings) for k, t in x.items()} for op, x in self.calls.get(s, {}).items()}
        out = {s: one(s) for s in self.calls}
        for s, d in self.details.items():
            out.setdefault(s, {}).setdefault("select", {"ok": Times().view(self.settings), "error": Times().view(self.settings)})["details"] = dict(d)
        return {"spaces": out} if space is None else out.get(space, {})


def counted(operation: str):
    """Time a method whose first argument is the table's name."""

    def wrap(f):
        @functools.wraps(f)
        def call(self, space, *a, **k):
            began, ok = time.monotonic(), False
            try:
                out = f(self, space, *a, **k)
                ok = not (isinstance(out, tuple) and len(out) == 2 and out[1])
                return out
            finally:
                self._stats.observe(space, operation, ok, time.monotonic() - began)

        return call

    return wrap


class RateLimiter:
    """At most `burst` messages in `interval` seconds; tells how many were held back."""

    def __init__(self, interval: float = 60, burst: int = 10, clock=time.monotonic):
        self.interval, self.burst, self.clock = interval, burst, clock
        self.begin, self.said, self.missed = None, 0, 0

    def allow(self) -> tuple[bool, int]:
        now, missed = self.clock(), 0
        if self.begin is None or now - self.begin >= self.interval:
            self.begin, self.said, missed, self.missed = now, 0, self.missed, 0
        if self.said < self.burst:
            self.said += 1
            return True, missed
        self.missed += 1
        return False, 0
