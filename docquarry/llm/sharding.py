"""Sharding by sampled splitters: shards of near-equal bytes that are contiguous ranges of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.ranges import TIE, RangeParams, literal_array, prefix_sums
from docquarry.session import materialize

ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", params: RangeParams = RangeParams()) -> DataFrame:
    """One row a record: key, size, text_crc32, shard (0 to ``shards`` - 1), slot (gapless from 0 in each shard).

    Size: UTF-8 bytes of the text plus 16. A size-weighted key sample gives splitters; records are range-partitioned by them, and
    overfull ranges are subdivided. A record goes to the shard that the middle of its bytes falls in, in key order, so each shard's
    bytes are within the largest record's size of the mean, and a hot key's rows spread over as many shards as they fill.

    Null text: size 16, crc 0. Null keys come first. Ties (equal keys) are ordered by crc, size and a row id; equal rows are
    interchangeable. Empty table: no rows. Other columns are not read, whatever their names.
    """
    t = F.col(text)
    narrow = docs.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias(TIE),
    )
    narrow = materialize(narrow, "shard-keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    summed = prefix_sums(narrow, ["k", "text_crc32", "size", TIE], "size", "size", params)
    middle = F.expr(f"cast(((2 * __cum - size) * {shards}L) div {max(2 * total, 1)}L as int)")
    placed = materialize(summed.select("k", "size", "text_crc32", F.least(middle, F.lit(shards - 1)).alias("shard"), "__idx"), "shard-places")
    first = {r["shard"]: r["i"] for r in placed.groupBy("shard").agg(F.min("__idx").alias("i")).collect()}
    firsts = literal_array([{"i": first.get(s, 0)} for s in range(shards)], "struct<i:bigint>")
    return placed.select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("__idx") - F.get(firsts, F.col("shard"))["i"]).alias("slot"))
