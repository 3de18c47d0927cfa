"""The registered change feed makes several runs, compacts them and still gives the rows of its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from cinderbase import queries_general
from cinderbase.operators import changefeed

LARGE = "/root/testdata/sf0.1"


def test_runs_are_compacted_on_the_way(spark, monkeypatch):
    if not os.path.isdir(LARGE):
        pytest.skip("no test data")
    seen, compact = [], changefeed.compact
    monkeypatch.setattr(changefeed, "compact", lambda s, store, *a, **k: (seen.append(s.table(store).select("run").distinct().count()), compact(s, store, *a, **k))[1])
    got = Counter(tuple(r) for r in queries_general.p5_found(spark, LARGE).collect())
    assert seen == [8]
    con = duckdb.connect()
    con.execute(f"create view memory_log as select * from '{LARGE}/memory_log.parquet'")
    assert got == Counter(con.execute(queries_general.P5_SQL).fetchall())
