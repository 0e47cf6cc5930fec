"""The operator library; importing a module registers its queries."""

from __future__ import annotations

from ..registry import REGISTERED, Registered


def all_queries() -> list[Registered]:
    from . import business, figures, governed, relational, scalars, search, telemetry  # noqa: F401

    return list(REGISTERED.values())
