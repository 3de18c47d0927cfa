"""Searches over the whole query batch give the same rows as DuckDB, where the batch has many queries."""

import os
from collections import Counter

import duckdb
import pytest
from test_oracles import same

from cinderbase import queries_memory as qm

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["search_batch", "co_retrieval_batch", "retrieve_batch"])
def test_whole_batch(spark, name):
    if not os.path.isdir(LARGE):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(LARGE):
        con.execute(f"create view {f.split('.')[0]} as select * from '{LARGE}/{f}'")
    df = qm.queries()[name](spark, LARGE)
    cols = sorted(df.columns)
    rows = Counter(tuple(same(r[c]) for c in cols) for r in df.collect())
    got = con.execute(qm.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert rows == Counter(tuple(same(r[names.index(c)]) for c in cols) for r in got.fetchall())
    if "query" in cols:
        due = con.execute(f"WITH {qm.STORE} SELECT count(*) FROM store WHERE vec IS NOT NULL AND ingest_seq % 100 = 0").fetchone()[0]
        assert due > 64 and len({r[cols.index("query")] for r in rows}) == due
