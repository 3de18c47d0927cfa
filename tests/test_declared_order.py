"""Only values of sources that declare no order of day and month go through the path over the records."""

import pytest
from test_feed_and_time import us

from cinderbase.operators import timestamps

MEM = "ingest_seq long, client string, valid_from string, valid_until string"
DATES = ["25/03/2024", "04/05/2024", "26/05/2024"]
AUTUMN = "2024-11-03 01:30"


def read(spark, client, **kw):
    rows = [(k, client, d, AUTUMN if k == 1 else None) for k, d in enumerate(DATES)]
    apps = spark.createDataFrame([("m", "America/New_York", False), ("n", "America/New_York", None)], "client string, zone_id string, day_first boolean")
    return {(r["ingest_seq"], r["field_name"]): (r["utc_micros"], r["ambiguous"]) for r in timestamps.normalise(spark.createDataFrame(rows, MEM), apps, **kw).collect()}


def test_a_declared_order_needs_no_path(spark, monkeypatch):
    def fail(pdf):
        raise ValueError("a value with a declared order is on the path")

    monkeypatch.setattr(timestamps, "_summarise", fail)
    for client, offset in (("m", 4), (None, 0), ("unknown", 0)):
        got = read(spark, client)
        assert got[1, "valid_from"] == (us(2024, 4, 5, offset), True)  # month first, though the dates around it are not
        assert got[0, "valid_from"][1] is False and got[1, "valid_until"] == ((us(2024, 11, 3, 5, 30), True) if client == "m" else (us(2024, 11, 3, 1, 30), False))
    with pytest.raises(Exception, match="on the path"):
        read(spark, "n")


def test_without_one_the_path_decides(spark):
    assert read(spark, "n")[1, "valid_from"] == (us(2024, 5, 4, 4), True)
    assert read(spark, "m", declared=False)[1, "valid_from"] == (us(2024, 5, 4, 4), True)


def test_the_declared_prior_outweighs_the_path():
    assert timestamps.DECLARED_COST > 2 * (timestamps.SWITCH_COST + timestamps.BACK_COST) and timestamps.SECOND_COST > 2 * timestamps.BACK_COST
