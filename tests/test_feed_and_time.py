"""The change feed and the timestamps: brute force, edge cases, distributed against plain."""

import os
import random
from datetime import UTC, datetime

import pytest

from cinderbase.operators import changefeed, timestamps

FEED = "log_line long, event_no long, event_type string, memory_id string, link_a string, link_b string, at_ms long, writer_seq long, run string, bucket int"


def brute(rows):
    last = {}
    for r in rows:
        kind = "".join(c for c in (r[2] or "").lower() if c.isalpha())
        clean = lambda v: (v or "").strip().lower() or None
        if kind in ("memory", "memorydelete"):
            key = ("memory", clean(r[3]), "")
        elif kind in ("link", "linkdelete"):
            a, b = clean(r[4]), clean(r[5])
            key = ("link", *(sorted((a, b)) if a and b else (None, None)))
        else:
            continue
        if key[1] is None:
            continue
        low = lambda v: (v is not None, v or 0)
        seq = (low(r[6]), low(r[7]), low(r[1]), kind.endswith("delete"))
        if key not in last or seq > last[key][0]:
            last[key] = (seq, r[1], kind.endswith("delete"))
    return {(*k, v[1]) for k, v in last.items() if not v[2]}


def feed(n=400, seed=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        t = rnd.choice(["memory", "Memory ", "memory_delete", "memoryDelete", "LINK", "link_delete", "meta", None])
        rows.append((i, rnd.randrange(n), t, rnd.choice(["M1", " m1", "m2", "m3", None, ""]), rnd.choice(["a", "B ", None]), rnd.choice(["b", "c"]), rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, None]), "x", 0))
    return rows + rows[:50]


@pytest.mark.parametrize("run_rows", [10_000, 30, 7])
def test_feed_against_brute_force(spark, run_rows):
    rows = feed()
    got = changefeed.apply_feed(spark.createDataFrame(rows, FEED), run_rows=run_rows)
    assert {(r["entity_kind"], r["key_a"], r["key_b"], r["event_no"]) for r in got.collect()} == brute(rows)


def test_feed_empty_payload_and_runs(spark, tmp_path):
    assert changefeed.apply_feed(spark.createDataFrame([], FEED)).count() == 0
    rows = [(0, 1, "memory", "a", None, None, 5, 1, "first", 0), (1, 2, "memory_delete", "a", None, None, 6, 1, "x", 0), (2, 3, "memory", "a", None, None, 7, 1, "again", 0)]
    df = spark.createDataFrame(rows, FEED)
    got = changefeed.apply_feed(df, payload=("run",)).collect()
    assert [(r["event_no"], r["run"]) for r in got] == [(3, "again")]
    changes = changefeed.canonical_changes(df)
    store = changefeed.new_store(spark)
    for k, pick in enumerate((2, 0, 1)):  # out of order
        changefeed.append_run(changefeed.canonical_changes(df.where(f"log_line = {pick}")), store, k)
    assert changefeed.merge_runs(spark, store).count() == 1 and changes.count() == 3
    other = changefeed.new_store(spark)
    changefeed.append_run(changefeed.canonical_changes(df.where("log_line < 2")), other, 0)
    partial = changefeed.compact(spark, other, full=False)
    assert changefeed.merge_runs(spark, partial, keep_tombstones=True).count() == 1 and changefeed.merge_runs(spark, partial).count() == 0


def test_runs_are_merged_without_a_shuffle(spark, data):
    from cinderbase.session import table

    plan = changefeed.apply_feed(table(spark, data, "memory_log"), run_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize("raw,zone,first,want", [
    ("2024-03-10T02:30:00", "America/New_York", False, us(2024, 3, 10, 7, 30)),  # skipped: forward by the gap
    ("2024-11-03 01:30", "America/New_York", False, us(2024, 11, 3, 5, 30)),  # twice: the first
    ("2024-04-07 01:45:00", "Australia/Lord_Howe", True, us(2024, 4, 6, 14, 45)),
    ("03/04/2024", "UTC", True, us(2024, 4, 3)), ("03/04/2024", "UTC", False, us(2024, 3, 4)), ("03/04/2024", "UTC", None, us(2024, 4, 3)),
    ("31/12/2024 11:05 p.m.", "UTC", True, us(2024, 12, 31, 23, 5)), ("12/31/2024 12:00 AM", "UTC", False, us(2024, 12, 31)),
    ("1.2.2024 05:06", "Asia/Kolkata", False, us(2024, 1, 31, 23, 36)),
    ("10. August 2024, 20:06 Uhr", "Europe/Berlin", True, us(2024, 8, 10, 18, 6)), ("9 Sep 2024, 20:47", "UTC", True, us(2024, 9, 9, 20, 47)),
    ("Fri, 01 Mar 2024 05:59:15 +0545", "UTC", True, us(2024, 3, 1, 0, 14, 15)), ("20240612", "Asia/Tokyo", True, us(2024, 6, 11, 15)),
    ("20240416T011034Z", "Asia/Tokyo", True, us(2024, 4, 16, 1, 10, 34)), ("1687748893", "UTC", True, 1687748893_000_000), ("1687238530.5", "UTC", True, 1687238530_500_000),
    ("1687639273593", "UTC", True, 1687639273593_000), ("1679794063812266", "UTC", True, 1679794063812266), ("2024-08-28t12:49:24.325456912z", "UTC", True, us(2024, 8, 28, 12, 49, 24, 325456)),
    (" 2024-01-01 00:00:00 UTC+00:00\t", "Asia/Tokyo", True, us(2024, 1, 1)), ("2024-01-01T00:00:00[Asia/Kathmandu]", "UTC", True, us(2023, 12, 31, 18, 15)), ("2024-01-01T01:00:00 America/New_York", "UTC", True, us(2024, 1, 1, 6)),
    ("2025-06-01 10:00:00,437", "UTC", True, us(2025, 6, 1, 10, 0, 0, 437000)), ("2025-06-01 10:00:00 EDT", "UTC", True, us(2025, 6, 1, 14)),
])
def test_readings(raw, zone, first, want):
    _, readings = timestamps.interpret(raw, zone, first)
    assert min(readings, key=lambda r: r[2])[1] == want


@pytest.mark.parametrize("raw", ["", "  ", None, "soon", "n/a", "0000-00-00", "2024-02-30", "25:61", "2024-13-01T00:00:00Z", "2023-00-10 10:00", "13:05 pm", "1/1/2024 13:05 pm", "12345", "99999999", "x" * 5000])
def test_no_time(raw):
    assert timestamps.interpret(raw, "UTC", True)[1] == []


MEM = "ingest_seq long, client string, valid_from string, valid_until string, zone_id string, block int"
APPS = "client string, zone_id string, day_first boolean"


def test_blocks_give_the_plain_viterbi_path(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), f"{rnd.randint(1, 12)}/{rnd.randint(1, 28)}/202{rnd.randint(3, 5)}", rnd.choice([None, "2024-05-05", "soon"]), "clash", 0) for i in range(300)]
    apps = spark.createDataFrame([("a", "UTC", None), ("b", None, None)], APPS)
    m = spark.createDataFrame(rows, MEM)
    small = {(r["ingest_seq"], r["field_name"]): r["utc_micros"] for r in timestamps.normalise(m, apps, block_rows=7).collect()}
    for client in ("a", "b", None):
        recs, keys = [], []
        for r in rows:
            if r[1] == client:
                shape = timestamps.interpret(r[2], "UTC", None if client else False)[1]
                if shape:
                    recs.append(([x[0] for x in shape], [x[1] for x in shape], [x[2] for x in shape]))
                    keys.append(r[0])
        cost = lambda picks: recs[0][2][picks[0]] + sum(timestamps._step(a, b, i, j) for a, b, i, j in zip(recs, recs[1:], picks, picks[1:]))
        best = timestamps.viterbi(recs)
        mine = [rec[1].index(small[k, "valid_from"]) for rec, k in zip(recs, keys)]
        assert cost(mine) == pytest.approx(cost(best))
    assert sum(v is None for (_, f), v in small.items() if f == "valid_until") == sum(r[3] == "soon" for r in rows)


def test_timestamps_edge_tables(spark):
    apps = spark.createDataFrame([("a", "Europe/Berlin", True), ("a", "Europe/Berlin", True)], APPS)
    assert timestamps.normalise(spark.createDataFrame([], MEM), apps).count() == 0
    rows = [(None, "a", "1/2/2024", None, None, None), (5, None, "1/2/2024", "", None, None), (5, None, "1/2/2024", "", None, None)]
    got = sorted((r["ingest_seq"] or 0, r["field_name"], r["utc_micros"] or 0) for r in timestamps.normalise(spark.createDataFrame(rows, MEM), apps).collect())
    assert got == [(0, "valid_from", us(2024, 1, 31, 23)), (5, "valid_from", us(2024, 1, 2)), (5, "valid_from", us(2024, 1, 2)), (5, "valid_until", 0), (5, "valid_until", 0)]
    assert timestamps.normalise(spark.createDataFrame(rows, MEM), apps.limit(0)).count() == 5


def test_scratch_tables_are_cleared(spark):
    import os

    from cinderbase.session import clear_scratch, scratch

    path = scratch(spark, "t")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    assert clear_scratch(spark) >= 1 and not os.path.exists(local) and clear_scratch(spark) == 0


def _undeclared(spark, **kw):
    """A source that writes day first, then changes to month first, and declares nothing."""
    days = ["25/03/2024", "04/05/2024", "26/05/2024", "07/06/2024", "28/06/2024", "07/13/2024", "08/05/2024", "08/25/2024", "09/06/2024", "09/27/2024"]
    rows = [(k, d, None, "c") for k, d in enumerate(days)]
    m = spark.createDataFrame(rows, "ingest_seq long, valid_from string, valid_until string, client string")
    clients = spark.createDataFrame([("c", "UTC", None)], "client string, zone_id string, day_first boolean")
    got = {r["ingest_seq"]: r["utc_micros"] for r in timestamps.normalise(m, clients, **kw).collect()}
    return [got[k] for k in range(len(days))]


def test_the_path_decides_without_a_declaration(spark, monkeypatch):
    want = [us(2024, 3, 25), us(2024, 5, 4), us(2024, 5, 26), us(2024, 6, 7), us(2024, 6, 28), us(2024, 7, 13), us(2024, 8, 5), us(2024, 8, 25), us(2024, 9, 6), us(2024, 9, 27)]
    assert _undeclared(spark) == want == _undeclared(spark, block_rows=3)


def test_without_its_costs_the_path_reads_otherwise():
    records = [timestamps.interpret(d, "UTC", None)[1] for d in ("07/13/2024", "08/05/2024", "08/25/2024")]
    records = [tuple(map(list, zip(*r))) for r in records]
    chosen = timestamps.viterbi(records)
    assert [r[0][k] for r, k in zip(records, chosen)] == ["M", "M", "M"]
    assert [r[0][min(range(len(r[2])), key=r[2].__getitem__)] for r in records] == ["M", "D", "M"]  # each value alone


def test_declared_orders_are_found_again(spark):
    from cinderbase import queries_general

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test data")
    rows = queries_general.p4_orders(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n_as_declared"] for r in rows) >= 0.85 * sum(r["n_ambiguous"] for r in rows) > 10


def test_records_without_a_number(spark):
    m = spark.createDataFrame([(None, "03/04/2024", None, "c"), (None, "2024-01-02", "x", None)], "ingest_seq long, valid_from string, valid_until string, client string")
    clients = spark.createDataFrame([("c", "UTC", True)], "client string, zone_id string, day_first boolean")
    assert sorted(r["utc_micros"] or 0 for r in timestamps.normalise(m, clients).collect()) == [0, us(2024, 1, 2), us(2024, 4, 3)]
