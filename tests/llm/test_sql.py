import os

import duckdb
import pytest

from crateflow.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*want.columns).collect()) == sorted(repr(r) for r in want.fetchall())
