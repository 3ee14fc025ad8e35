"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op01_line_dedup", "op02_pii", "op03_quality_rules", "op04_mixing", "op05_lm_score", "op06_language_id", "op07_chat_format", "op08_decontaminate", "op09_substring_dedup", "op10_near_dedup")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
