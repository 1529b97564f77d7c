"""Landed listings through their data source: batches, pushed filters, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan

from docquarry.session import ship_package
from docquarry.sources import landed


def put(folder, day, entity, filings, **change):
    at = folder / f"day={day}"
    at.mkdir(parents=True, exist_ok=True)
    recent = {k: [f[i] for f in filings] for i, k in enumerate(("form", "accessionNumber", "primaryDocument", "acceptanceDateTime"))} | change
    (at / f"{entity}.json").write_text(json.dumps({"entity": entity, "filings": {"recent": recent}}) + "\n")


@pytest.fixture
def folder(spark, tmp_path):
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(landed.ListingSource)
    put(tmp_path / "in", "2024-01-01", "a", [("10-K", "1", "x.htm", "t"), ("8-K", "2", "", "t"), ("8-K", "3", "y.htm", "t")])
    put(tmp_path / "in", "2024-02-01", "b", [("10-K", "4", "x.htm", "t")])
    return tmp_path / "in"


def keys(df):
    return sorted(r["accession"] for r in df.collect())


def test_batches_and_filters(spark, folder):
    read = lambda: spark.read.format("landed_listings").load(str(folder))
    assert keys(read()) == ["1", "3", "4"]
    assert keys(read().where("day > '2024-01-01'")) == ["4"] and keys(read().where("form = '10-K' and entity = 'a'")) == ["1"]
    assert keys(read().where("form = '8-K' and form = '10-K'")) == [] and keys(read().where("day < '2000-01-01'")) == []
    (folder / "day=2024-03-01").mkdir()
    (folder / "day=2024-03-01" / "bad.json").write_text("not json\n")
    assert keys(read().where("day <= '2024-02-01'")) == ["1", "3", "4"]  # a file of another day isn't opened
    with pytest.raises(Exception, match="JSON|json|Expecting"):
        read().collect()


def test_what_is_pushed(folder):
    r = landed.ListingReader(str(folder), 1)
    left = list(r.pushFilters([GreaterThan(("day",), "2024-01-01"), EqualTo(("form",), "10-K"), EqualTo(("entity",), "b")]))
    assert left == [EqualTo(("entity",), "b")] and [len(p.paths) for p in r.partitions()] == [1]
    assert len(landed.ListingReader(str(folder), 2).partitions()) == 2 and landed.ListingReader(str(folder / "none"), 2).partitions()[0].paths == []


def test_unequal_arrays_are_an_error(spark, folder):
    put(folder, "2024-02-01", "c", [("10-K", "5", "x.htm", "t")], form=[])
    with pytest.raises(Exception, match="unequal"):
        spark.read.format("landed_listings").load(str(folder)).collect()


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        q = spark.readStream.format("landed_listings").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start()
        q.awaitTermination()

    run()
    assert keys(spark.read.parquet(out)) == ["1", "3", "4"]
    put(folder, "2024-02-02", "a", [("10-K", "6", "x.htm", "t")])
    for _ in range(2):
        run()
    assert keys(spark.read.parquet(out)) == ["1", "3", "4", "6"]
