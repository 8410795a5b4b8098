"""Registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

import importlib

#: One module for each problem; each holds QUERIES and, where SQL can express it, SQL.
MODULES = ("p01_encoding", "p02_survivor", "p03_cut", "p04_site_lines", "p05_match", "p06_batches", "p07_places", "p08_tokens", "p09_mix", "p10_personal")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= getattr(_m, "SQL", {})
