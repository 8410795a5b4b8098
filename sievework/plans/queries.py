"""All registered queries of the core and the SQL that must give the same rows."""

from __future__ import annotations

from . import q_cur, q_feed, q_page, q_rel, q_stream, q_text

QUERIES: dict = {**q_stream.QUERIES}
SQL: dict[str, str] = {**q_stream.SQL}
for _m in (q_text, q_rel, q_page, q_feed, q_cur):
    QUERIES |= _m.reg.queries
    SQL |= _m.reg.sql
