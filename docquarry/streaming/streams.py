"""Structured Streaming forms: files in, deduplicated or windowed rows out, and idempotent ledger appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import ledger
from docquarry.session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files; naive times become UTC at this boundary."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source takes a folder or a glob, so that one file is a stream of one
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), late: str = "40 days") -> DataFrame:
    """The first row of each key; state is bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Session windows of a user and their event counts; emitted once the watermark has passed their end."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _last_mark(events: DataFrame, late: str) -> DataFrame:
    """One row: the watermark after the last event."""
    return events.agg(F.max("ts").alias("last")).select((F.timestamp_millis(F.unix_millis("last")) - F.expr(f"interval {late}")).alias("mark"))


def open_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """What ``sessions`` leaves open when the stream of ``events`` (here a table) has ended: those that end after the last watermark."""
    w = F.session_window("ts", gap)
    all_ = events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    return all_.join(F.broadcast(_last_mark(events, late)), F.col("end") > F.col("mark")).drop("mark")


def _windowed(events: DataFrame, length: str, slide: str | None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by event type in tumbling windows, or sliding ones; emitted once the watermark has passed their end."""
    return _windowed(events.withWatermark("ts", late), length, slide)


def open_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """What ``windows`` leaves open when the stream of ``events`` (here a table) has ended."""
    return _windowed(events, length, slide).join(F.broadcast(_last_mark(events, late)), F.col("end") > F.col("mark")).drop("mark")


def run_to_end(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Runs what there is now and returns the rows written; output and progress are in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def append_to_ledger(stream: DataFrame, path: str, progress: str, keys: tuple[str, ...] = ledger.KEYS):
    """Starts an idempotent append: a batch, replayed or not, adds only keys that the ledger lacks."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        held = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        fresh = batch.dropDuplicates(list(keys))
        fresh = ledger.new_rows(spark.read.schema(batch.schema).parquet(path), fresh, keys) if held else fresh
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
