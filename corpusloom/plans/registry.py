"""All queries of the reference's operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

for _name in ("texts", "timed", "state", "vectors", "stateful", "samples", "decisions"):
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
