"""Queries of the image engine over tables carried as images, and the SQL that gives the same rows."""

from __future__ import annotations

from glyphlake.plans import queries as q, sql

QUERIES = {name: getattr(q, name) for name in q.NAMES}
ORACLE_SQL: dict[str, str] = dict(sql.SQL)


def flagship(spark, sf_dir):
    return q.chunk_stats(spark, sf_dir)
