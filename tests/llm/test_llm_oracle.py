"""The queries of this subpackage that have SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from siftlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns and ours
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
    if name == "op10_chat":
        valid = columns.index("valid")
        assert {r[valid] for r in ours} == {"True", "False"}
