"""Every query of the subpackage runs on the smallest data, and agrees with its SQL."""

from pathlib import Path

import duckdb
import pytest

from quillmap.llm.queries import QUERIES, SQL
from tests.test_queries import ROOT, canonical


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, ROOT)
    rows = df.collect()
    if name in SQL:
        con = duckdb.connect()
        for path in Path(ROOT).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        cursor = con.execute(SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, [tuple(r) for r in rows]) == canonical(columns, cursor.fetchall())
