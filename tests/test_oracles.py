"""Every query of the core with an SQL twin gives the same rows as DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from cinderbase import queries_general, queries_memory

SQL = queries_memory.oracle_sql() | queries_general.oracle_sql()
QUERIES = queries_memory.queries() | queries_general.queries()
#: Nothing at the smallest size meets this filter.
MAY_BE_EMPTY = {"query_memories", "conflict_effects", "search_bridge", "search_bridge_batch"}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, con, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = Counter(tuple(same(r[c]) for c in cols) for r in df.collect())
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = Counter(tuple(same(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert rows == want
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0 or name in MAY_BE_EMPTY


def test_entry_needs_no_session_at_import():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
