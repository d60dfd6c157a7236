"""All queries of the llm subpackage and the SQL they are compared with."""

from __future__ import annotations

from graphloom.llm import queries as _q

_MODULES = (_q,)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
