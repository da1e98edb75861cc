"""Every query against its SQL over the same tables."""

import glob
import os

import duckdb
import pytest

from glyphlake.plans import registry

SF = "/root/testdata/sf0.001"


def normal(rows):
    def text(v):
        return f"{v:.9g}" if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v).lower() if isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = normal(df.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    r = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    assert normal(r.select(*[f'"{c}"' for c in columns]).fetchall()) == rows


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_dynamic_tables_are_complete_codes(spark):
    rows = registry.QUERIES["huffman_tables"](spark, SF).collect()
    assert rows and all(r["space"] == 1 << 15 or r["entries"] == 1 for r in rows)
