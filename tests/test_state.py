"""Breaker and cap over a stream, with a restart in between, beside the same over a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docquarry.streaming import state


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """The events in four files, in order."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole = state.event_calls(e).withColumn("part", F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("seq")))
    path = tmp_path_factory.mktemp("calls")
    for k in range(1, 5):
        whole.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(str(path / f"in{k}"))
    return whole.drop("part").cache(), path


def run(spark, source, out, checkpoint, **kwargs):
    schema = "user_id long, seq long, ts timestamp, failed boolean, cost double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    state.run_guarded(stream, "user_id", 2, 800.0, out, checkpoint, **kwargs)


def test_stream_with_a_restart_equals_the_table(spark, calls, tmp_path):
    whole, path = calls
    source, out, mark = tmp_path / "source", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    for k in (1, 2, 3, 4):
        for f in (path / f"in{k}").glob("*.parquet"):
            f.rename(source / f"{k}-{f.name}")
        if k % 2 == 0:  # the query ends and starts anew
            run(spark, str(source), out, mark)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in state.guard_table(whole, "user_id", 2, 800.0).collect())
    assert got == want and any(r[3] for r in got) and any(not r[5] for r in got)


def test_initial_spending_and_silence(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, 1, at, False, 5.0), (1, 2, at, False, 5.0), (2, 1, at, True, 1.0)]
    later = [(2, 3, at + dt.timedelta(days=9), True, 1.0), (2, 2, at + dt.timedelta(days=9), False, 1.0)]
    schema = "user_id long, seq long, ts timestamp, failed boolean, cost double"
    source = tmp_path / "source"
    for k, part in enumerate((rows, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        spent = spark.createDataFrame([(1, 798.0), (3, 1.0)], "user_id long, spent double")
        run(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"), spent=spent, silent_hours=48)
    got = {(r["user_id"], r["seq"]): (r["spent_before"], r["allowed"], r["streak"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 1] == (798.0, True, 0) and got[1, 2] == (803.0, False, 0)
    assert got[2, 1] == (0.0, True, 1) and got[2, 2][2] == 0 and got[2, 3][2] == 1
