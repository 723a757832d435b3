"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from tidewater.plans import panels, portfolio, quality, report, research, stats, streams, tables, windows

_MODULES = (windows, stats, portfolio, quality, research, report, panels, tables, streams)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
FLAGSHIP = "momentum_legs"
