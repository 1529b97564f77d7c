"""Sampled splitters and exact prefix sums over range-partitioned records (shared by sharding and mixing).

``narrow`` tables hold keys and sizes only, never texts, and are materialized first, so that every pass over them is cheap and
every pass sees the same tie-breaking ids. Splitters are drawn from a size-weighted sample whose expected size is a parameter,
and ranges that come out overfull are subdivided at further sample keys before any row moves.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = "__tie"


@dataclass(frozen=True)
class RangeParams:
    """``ranges`` at least; more so that a range holds about ``rows_per_range``, up to ``max_ranges``. ``oversample`` keys a range."""

    ranges: int = 640
    rows_per_range: int = 1_000_000
    max_ranges: int = 16_384
    oversample: int = 16
    overfull: float = 2.0


def literal_array(rows: list[dict], ddl: str) -> Column:
    """A bounded driver-side list as one constant column (folded once, not rebuilt for each row)."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<{ddl}>")


def count_at_most(sorted_array: Column, n: int, key: Column) -> Column:
    """How many of the ``n`` ascending entries are <= ``key``: a binary search inside one expression."""
    steps = max(1, n.bit_length())

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = F.get(sorted_array, mid) <= key
        return F.when(
            s["lo"] < s["hi"],
            F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go, s["hi"]).otherwise(mid).alias("hi")),
        ).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def _ddl(df: DataFrame, cols: list[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in cols) + ">"


def _pick(sample: list[tuple], k: int) -> list[dict]:
    """Weighted quantile boundaries: ``k`` - 1 keys that cut the ascending ``sample`` of (key, weight) evenly."""
    total, run, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        if len(out) + 1 < k and run >= total * (len(out) + 1) / k:
            out.append(key)
        run += w
    return out


def splitters(narrow: DataFrame, order: list[str], load: str, n_rows: int, total_load: int, p: RangeParams) -> tuple[list[dict], list]:
    """(splitter keys ascending, per-range rows of (range, rows, load)). ``order`` must be a total order and end in ``TIE``."""
    k = int(min(p.max_ranges, max(p.ranges, -(-n_rows // p.rows_per_range))))
    m = k * p.oversample
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(7), *order), 11) / F.lit(float(1 << 53))
    weight = F.greatest(F.col(load).cast("double"), F.lit(total_load / m))
    # ordering is done by Spark, so that keys of any type compare here as they do in the ranges
    got = narrow.where(unit < F.col(load) * F.lit(m / max(total_load, 1))).select(*order, weight.alias("__w")).orderBy(*order).collect()
    sample = [({c: r[c] for c in order}, r["__w"]) for r in got]
    chosen = _pick(sample, k)
    for _ in range(3):
        per = narrow.groupBy(range_of(narrow, order, chosen).alias("__range")).agg(F.count("*").alias("n"), F.sum(load).alias("load")).collect()
        over = {r["__range"]: max(r["load"] / (total_load / k), r["n"] / (n_rows / k)) for r in per}
        over = {i: x for i, x in over.items() if x > p.overfull}
        if not over:
            break
        # sample keys by the range that they fall in; a splitter is itself a sample key
        places, at = {}, 0
        marks = [json.dumps(c, default=str) for c in chosen]
        for key, w in sample:
            if at < len(marks) and json.dumps(key, default=str) == marks[at]:
                at += 1
            places.setdefault(at, []).append((key, w))
        more = {i: _pick(places.get(i, []), int(x) + 1) for i, x in over.items()}
        out = []
        for i in range(len(chosen) + 1):
            out += ([chosen[i - 1]] if i else []) + [c for c in more.get(i, []) if not i or c != chosen[i - 1]]
        if len(out) == len(chosen):
            break
        chosen = out
    return chosen, per


def range_of(df: DataFrame, order: list[str], chosen: list[dict]) -> Column:
    if not chosen:
        return F.lit(0)
    return count_at_most(literal_array(chosen, _ddl(df, order)), len(chosen), F.struct(*order))


def prefix_sums(narrow: DataFrame, order: list[str], add: str, load: str, p: RangeParams = RangeParams()) -> DataFrame:
    """Adds ``__cum`` (inclusive sum of ``add`` in ``order``) and ``__idx`` (rows before this one), over the whole table, exactly.

    One shuffle, of the narrow rows, by range; ranges hold about equal loads, and their totals (one row a range) come from a
    partial aggregate, so no task and no driver step sees more than a range or one row a range.
    """
    n, total, _ = narrow.agg(F.count("*"), F.sum(load), F.sum(add)).first()
    if not n:
        return narrow.withColumns({"__cum": F.lit(0).cast("long"), "__idx": F.lit(0).cast("long")})
    chosen, _ = splitters(narrow, order, load, n, total, p)
    ranged = narrow.withColumn("__range", range_of(narrow, order, chosen))
    per = {r["__range"]: (r["n"], r["s"]) for r in ranged.groupBy("__range").agg(F.count("*").alias("n"), F.sum(add).alias("s")).collect()}
    offsets, rows, cum = [], 0, 0
    for i in range(len(chosen) + 1):
        offsets.append({"r": rows, "c": cum})
        rows, cum = rows + per.get(i, (0, 0))[0], cum + per.get(i, (0, 0))[1]
    at = F.get(literal_array(offsets, "struct<r:bigint,c:bigint>"), F.col("__range"))
    w = Window.partitionBy("__range").orderBy(*order)
    return ranged.withColumns(
        {
            "__cum": F.sum(add).over(w.rowsBetween(Window.unboundedPreceding, 0)) + at["c"],
            "__idx": F.row_number().over(w) - 1 + at["r"],
        }
    ).drop("__range")
