"""What a Python worker keeps from one task to the next, where this package is installed.

Only results that a task could work out again are kept here, so a fresh worker loses time alone.
"""

from __future__ import annotations

CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    return CACHES.setdefault(name, {})
