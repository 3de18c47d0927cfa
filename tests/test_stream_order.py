"""What a stream gives does not depend on the number of files or their order."""

import os

from pyspark.sql import functions as F

from cinderbase import queries_memory as qm


def test_boosts_of_many_files_latest_first(spark, data, tmp_path):
    for f in os.listdir(data):
        if f != "access_log.parquet":
            os.symlink(f"{data}/{f}", tmp_path / f)
    log = spark.read.parquet(f"{data}/access_log.parquet")
    ends = [None, *log.selectExpr("percentile_approx(unix_micros(ts), array(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) AS e").first()["e"], None]
    us = F.unix_micros("ts")
    for low, high in reversed(list(zip(ends, ends[1:]))):
        part = log if low is None else log.where(us >= low)
        part = part if high is None else part.where(us < high)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "access_log.parquet"))
    got = {r["memory_seq"]: (r["n_accesses"], r["stability"]) for r in qm.stream_boost(spark, str(tmp_path)).collect()}
    want = {r["memory_seq"]: (r["n_accesses"], r["stability"]) for r in qm.boost_replay(spark, data).collect()}
    assert got == want and want
