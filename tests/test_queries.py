"""Every core query runs on the smallest data, and agrees with its SQL."""

from pathlib import Path

import duckdb
import pytest

from quillmap.plans import registry

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        return round(x, 5) + 0.0 if isinstance(x, float) else x

    return sorted(repr(tuple(one(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, ROOT)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        cursor = db.execute(registry.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert mine == canonical(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
