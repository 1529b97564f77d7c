"""The append-only document ledger, content caches and versioned tables, as joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("source", "doc_id", "status")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])


def new_rows(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Incoming rows whose key the ledger lacks. Keys compare null-safely; repeats inside one batch are all kept."""
    missing = [k for k in keys if k not in existing.columns or k not in incoming.columns]
    if not keys or missing:
        raise ValueError(f"unknown or empty keys: {missing or keys}")
    return incoming.join(existing.select(*keys), _same(incoming, existing, keys), "left_anti")


def append(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return existing.unionByName(new_rows(existing, incoming, keys))


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key in listing order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(position))).where("__r = 1").drop("__r")


def incremental(listing: DataFrame, ledger: DataFrame, key: str = "doc_id", position: str = "position") -> DataFrame:
    """Listed rows to fetch: first occurrence of each key, without those the ledger holds as ok."""
    done = ledger.where(F.col("status") == "ok").select(key).distinct()
    return first_seen(listing, key, position).join(done, key, "left_anti")


def contains(ledger: DataFrame, asked: DataFrame, any_status: bool = False) -> DataFrame:
    """``asked`` with a flag: whether the ledger has (source, doc_id), with that status unless any will do."""
    keys = ["source", "doc_id"] + ([] if any_status else ["status"])
    held = ledger.select(*keys).distinct().withColumn("found", F.lit(True))
    return asked.join(held, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def cache_split(keyed: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Marks hits; a hit carries the cached payload."""
    hit = cache.select(key, F.col("payload"), F.lit(True).alias("hit"))
    return keyed.join(hit, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def staged(writes: DataFrame, group: str, ok: str = "ok") -> DataFrame:
    """All-or-nothing: rows of groups whose every write succeeded."""
    good = writes.groupBy(group).agg(F.bool_and(ok).alias("__all")).where("__all").select(group)
    return writes.join(good, group, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Delete by key, then insert."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def retained(history: DataFrame, active: str, keep: int) -> DataFrame:
    """(version, keep) of every promoted version: the active one, and the newest distinct others up to ``keep`` in all."""
    last = history.groupBy("version").agg(F.max("position").alias("position"))
    rank = F.row_number().over(Window.orderBy((F.col("version") == active).desc(), F.col("position").desc()))
    return last.select("version", (rank <= keep).alias("keep"))


def identity_agreement(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per group: each field's agreed value, and which fields disagree. A missing value counts as a value."""
    as_text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None"))
    got = rows.groupBy(group).agg(*[F.min(as_text(f)).alias(f"{f}_lo") for f in fields], *[F.max(as_text(f)).alias(f"{f}_hi") for f in fields])
    clash = F.array_compact(F.array(*[F.when(F.col(f"{f}_lo") != F.col(f"{f}_hi"), F.lit(f)) for f in fields]))
    return got.select(group, *[F.when(F.col(f"{f}_lo") == F.col(f"{f}_hi"), F.col(f"{f}_lo")).alias(f) for f in fields], F.array_join(clash, ",").alias("disagreeing"))


def running_cap(usage: DataFrame, group: str, order: str, cost: str, cap: float) -> DataFrame:
    """Marks calls that the cap lets through: those before which no more than ``cap`` had been spent."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return usage.withColumn("spent_before", before).withColumn("allowed", ~(before > cap))


def circuit_breaker(calls: DataFrame, group: str, order: str, failed: str, threshold: int) -> DataFrame:
    """Marks calls that find the breaker open: ``threshold`` failures in a row have occurred before them."""
    w = Window.partitionBy(group).orderBy(order)
    run = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)
    inside = Window.partitionBy(group, "__run").orderBy(order)
    streak = F.when(F.col(failed), F.sum(F.col(failed).cast("int")).over(inside)).otherwise(0)
    got = calls.withColumn("__run", run).withColumn("streak", streak)
    tripped = F.max((F.col("streak") >= threshold).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return got.withColumn("open", F.coalesce(tripped, F.lit(0)) == 1).drop("__run")
