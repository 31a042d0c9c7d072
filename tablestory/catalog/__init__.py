"""Queries over the supplied tables, one per operator, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import feeds, findings, profiling, runs

_PARTS = (profiling, findings, runs, feeds)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
