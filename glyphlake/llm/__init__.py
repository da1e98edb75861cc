"""Operators of a training-data pipeline; nothing outside this folder imports it."""

from __future__ import annotations

from glyphlake.llm import registry


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE_SQL)
