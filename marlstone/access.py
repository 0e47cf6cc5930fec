"""Profiles, scope overrides, quotas and the preflight query."""

from __future__ import annotations

import threading
import time
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from . import catalog
from .scope import Scope, ScopeRefused, unknown_brands
from .sources.store import Store

LIMITS = {"llm_hour": 100, "llm_day": 1000, "bytes_day": 100 * 10**9}


def parse_profiles(entries: list[dict]) -> dict[str, Scope]:
    """id -> scope; a profile without brands must say all_products."""
    out: dict[str, Scope] = {}
    for e in entries:
        if not isinstance(e.get("id"), str) or e["id"] in out:
            raise ScopeRefused("profile_invalid")
        out[e["id"]] = Scope(tuple(e.get("brands") or ()), bool(e.get("all_products", False)))
    return out


@dataclass
class Access:
    spark: SparkSession
    sf_dir: str
    store: Store
    scopes: dict[str, Scope]

    def set_scope(self, actor: str, user: str, scope: Scope) -> None:
        """Override a user's scope: every brand must exist; the change is audited."""
        if not scope.everything and unknown_brands(self.spark, self.sf_dir, scope).take(1):
            raise ScopeRefused("unknown_brand")
        self.store._audit(actor, f"{user}:{scope.key}:{time.time_ns()}", "access.set", [user], 1, "ok")
        self.scopes[user] = scope


def preflight(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each shop table can be read."""
    return all(view(spark, sf_dir).limit(1).count() <= 1 for view in catalog.VIEWS.values())


@dataclass
class Quota:
    """Uses by user, kind and UTC window; a call is let through before it is counted."""

    limits: dict[str, int] = field(default_factory=lambda: dict(LIMITS))
    clock: object = time.time
    used: Counter = field(default_factory=Counter)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def window(self, kind: str) -> str:
        at = datetime.fromtimestamp(self.clock(), timezone.utc)
        return at.strftime("%Y-%m-%dT%H" if kind.endswith("_hour") else "%Y-%m-%d")

    def left(self, user: str, kind: str) -> int:
        return max(0, self.limits[kind] - self.used[user, kind, self.window(kind)])

    def add(self, user: str, kind: str, n: int = 1) -> bool:
        """Count n uses; False, and nothing counted, if they exceed the limit."""
        with self.lock:
            if self.left(user, kind) < n:
                return False
            self.used[user, kind, self.window(kind)] += n
            return True


@dataclass
class TokenBucket:
    """Rate limit per model: ``rate`` tokens a second up to ``capacity``."""

    rate: float
    capacity: float
    clock: object = time.monotonic
    level: float | None = None
    at: float = 0.0

    def take(self, n: float = 1.0) -> float:
        """Seconds to wait before n tokens are there; 0.0 takes them."""
        now = self.clock()
        self.level = self.capacity if self.level is None else min(self.capacity, self.level + (now - self.at) * self.rate)
        self.at = now
        if self.level >= n:
            self.level -= n
            return 0.0
        return (n - self.level) / self.rate
