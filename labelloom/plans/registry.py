"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ["tables_queries", "sets_queries", "records_queries", "text_queries", "more_queries", "case_queries"]
FLAGSHIP = "r_01"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    _found = import_module(f"labelloom.plans.{_module}")
    QUERIES |= _found.Q
    ORACLE_SQL |= {k: v for k, v in _found.SQL.items() if v}
