"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import keyed_values, others, sorted_sets

_ALL = sorted_sets.QUERIES | keyed_values.QUERIES | others.QUERIES


def queries() -> dict:
    return {k: run for k, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in _ALL.items() if text}
