"""Mutual information by nearest neighbours (KSG) without a matrix of all pairs.

Points are cut into blocks of bounded size: strips of x by quantiles, then ranges of y, split by range whatever the ties. A point's k nearest
in its own block bound its k-th distance; only blocks whose box is nearer than that are asked for more. How many points are nearer in x or
in y alone are differences of ranks in sorted blocks. Tasks hold blocks; the driver holds boxes, at most ``most_blocks`` of each kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.analytics import digamma
from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class DependenceParams:
    block: int = 512
    sorted_block: int = 4096
    most_blocks: int = 1 << 20
    strips: int = 64


def _cut(rows: DataFrame, order: list[str], together: str, columns: list[str], size: int) -> DataFrame:
    """(block, g, lists of ``columns``): rows in ``order``, in blocks of at most ``size`` of one ``together``. One shuffle by range."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).chunk(0))
            return pa.RecordBatch.from_arrays([t.column("g").chunk(0).slice(0, 1), *(one(c) for c in columns)], ["g", *columns])

        for b in batches:
            key, at = b.column(0).to_numpy(), 0
            while at < len(key):
                have = sum(h.num_rows for h in held)
                if held and (have >= size or held[0].column(0)[0].as_py() != key[at]):
                    yield made()
                    held, have = [], 0
                end = min(at + size - have, int(np.searchsorted(key, key[at], "right")))
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield made()

    dealt = rows.select(F.col(together).alias("__key"), "g", *order, *[c for c in columns if c not in order]).repartitionByRange("__key", *order).sortWithinPartitions("__key", *order)
    cols = list(dict.fromkeys(["g", *columns]))
    return dealt.select("__key", *cols).mapInArrow(pack, "g int, " + ", ".join(f"{c} array<{k}>" for c, k in kinds.items())).withColumn("block", F.monotonically_increasing_id())


def _ranks(values: np.ndarray, x: np.ndarray, eps: np.ndarray, left: bool) -> np.ndarray:
    """How many of the ascending ``values`` lie below the open interval's end: v - x < eps on the right, x - v >= eps on the left. Exact for
    differences as they round, so that ties with the k-th neighbour fall as in a comparison of pairs."""
    ok = (lambda v: ~(x - v < eps)) if left else (lambda v: v - x < eps)
    at = np.searchsorted(values, x - eps if left else x + eps, "right" if left else "left")
    if not len(values):
        return at
    while True:
        back = (at > 0) & ~ok(values[np.maximum(at - 1, 0)])
        on = ~back & (at < len(values)) & ok(values[np.minimum(at, len(values) - 1)])
        if not back.any() and not on.any():
            return at
        at = np.where(back, np.searchsorted(values, values[np.maximum(at - 1, 0)], "left"), np.where(on, np.searchsorted(values, values[np.minimum(at, len(values) - 1)], "right"), at))


def mutual_information(df: DataFrame, group: str, x: str, y: str, k: int = 3, p: DependenceParams = DependenceParams()) -> DataFrame:
    """(group, n, mi): the estimate within each group, in nats, not below 0; null in groups of ``k`` points or fewer. Groups are a catalogue;
    points without a finite x and y are left out. Ties are points of their own. No task holds more than two blocks at a time."""
    spark = df.sparkSession
    ship_package(spark)
    finite = lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))
    given = df.select(F.col(group).alias("of"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite(F.col("x")) & finite(F.col("y")))
    marks = [i / p.strips for i in range(1, p.strips)]
    groups = given.groupBy("of").agg(F.count("*").alias("n"), F.percentile_approx("x", F.array(*map(F.lit, marks)), F.lit(1000)).alias("marks"))
    groups = materialize(groups.withColumn("g", (F.row_number().over(_by("of")) - 1).cast("int")), "mi-groups")
    sizes = {r["g"]: r["n"] for r in groups.select("g", "n").collect()}
    block = max(p.block, -(-sum(sizes.values()) // p.most_blocks))
    # as many strips as make blocks about as wide as they are high
    strips = F.greatest(F.lit(1), F.least(F.lit(p.strips), F.ceil(F.sqrt(F.col("n") / block)))).cast("int")
    strip = F.floor(F.size(F.filter("marks", lambda m: m <= F.col("x"))) * strips / p.strips).cast("long")
    points = given.join(F.broadcast(groups), given["of"].eqNullSafe(groups["of"])).select("g", "x", "y", strip.alias("strip"), F.monotonically_increasing_id().alias("id"))
    points = materialize(points.withColumn("key", F.col("g").cast("long") * p.strips + F.col("strip")), "mi-points")
    blocks = materialize(_cut(points, ["y", "x", "id"], "key", ["x", "y", "id"], block), "mi-blocks")
    edge = lambda f, c: f(F.col(c)).alias(f"{f.__name__[-3:]}_{c}")
    boxes = blocks.select("block", "g", *(edge(f, c) for c in ("x", "y") for f in (F.array_min, F.array_max))).orderBy("g", "block").collect()
    box = spark.sparkContext.broadcast({"block": np.array([b["block"] for b in boxes], np.int64), "g": np.array([b["g"] for b in boxes], np.int32), "at": np.array([b[2:6] for b in boxes], float).reshape(-1, 4)})

    def near(d: np.ndarray) -> np.ndarray:
        return np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, c, ids = (b.column(j)[i].values.to_numpy() for j in (2, 3, 4))
                d = np.maximum(np.abs(a[:, None] - a), np.abs(c[:, None] - c))
                np.fill_diagonal(d, np.inf)
                got = near(d)
                full = np.full((len(a), k), np.inf)
                full[:, : got.shape[1]] = got
                ends = np.arange(len(a) + 1, dtype=np.int32) * k
                fixed = [pa.array(np.full(len(a), v)) for v in (b.column(0)[i].as_py(),)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(a), b.column(1)[i].as_py(), np.int32)), *fixed, pa.array(a), pa.array(c), pa.ListArray.from_arrays(pa.array(ends), pa.array(full.ravel()))], ["id", "g", "block", "x", "y", "ds"])

    first = materialize(blocks.select("block", "g", "x", "y", "id").mapInArrow(own, "id long, g int, block long, x double, y double, ds array<double>"), "mi-own")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta = box.value
        for b in batches:
            ids, g, mine, a, c = (b.column(j).to_numpy() for j in range(5))
            most = np.array(b.column(5).flatten().to_numpy()).reshape(-1, k)[:, -1]
            for v in np.unique(g):
                these = np.flatnonzero(meta["g"] == v)
                for lo in range(0, len(g), 1024):
                    at = np.arange(lo, min(lo + 1024, len(g)))[g[lo : lo + 1024] == v]
                    q = meta["at"][these]
                    gap = np.maximum(np.maximum(q[:, 0] - a[at, None], a[at, None] - q[:, 1]), np.maximum(q[:, 2] - c[at, None], c[at, None] - q[:, 3]))
                    want = (gap <= most[at, None]) & (meta["block"][these] != mine[at, None])
                    for j in np.flatnonzero(want.any(axis=0)).tolist():
                        i = at[want[:, j]]
                        one = lambda z: pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), pa.array(z[i]))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array([int(meta["block"][these[j]])]), one(ids), one(a), one(c)], ["to", "ids", "ax", "ay"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, a, c, u, v = (b.column(j)[i].values.to_numpy() for j in range(5))
                got = near(np.maximum(np.abs(a[:, None] - u), np.abs(c[:, None] - v)))
                ends = np.arange(len(ids) + 1, dtype=np.int32) * got.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(got.ravel()))], ["id", "ds"])

    asked = first.select("id", "g", "block", "x", "y", "ds").mapInArrow(ask, "to long, ids array<long>, ax array<double>, ay array<double>")
    more = asked.join(blocks.select(F.col("block").alias("to"), "x", "y"), "to").select("ids", "ax", "ay", "x", "y").mapInArrow(answer, "id long, ds array<double>")
    kth = first.select("id", "ds").unionByName(more).groupBy("id").agg(F.get(F.array_sort(F.flatten(F.collect_list("ds"))), k - 1).alias("eps"))
    known = materialize(first.select("id", "g", "x", "y").join(kth, "id").where(F.col("eps") < F.lit(float("inf"))), "mi-known")
    nx, ny = (_nearer(points, known, c, p).alias(f"n{c}") for c in ("x", "y"))
    both = nx.withColumnRenamed("n", "nx").join(ny.withColumnRenamed("n", "ny"), "id").join(known.select("id", "g"), "id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sum(digamma(np.maximum(b.column(j).to_numpy() - 1, 0) + 1.0) for j in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["g", "s"])

    mean = both.select("g", "nx", "ny").mapInArrow(score, "g int, s double").groupBy("g").agg(F.avg("s").alias("s"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            mi = np.maximum(0.0, digamma(np.array([float(k)])) + digamma(n) - s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mi, pa.float64(), from_pandas=True)], ["of", "n", "mi"])

    kind = df.schema[group].dataType.simpleString()
    out = materialize(groups.join(mean, "g", "left").select("of", "n", F.when(F.col("n") > k, F.col("s")).alias("s")).mapInArrow(total, f"of {kind}, n long, mi double"), "mi")
    discard(groups, points, blocks, first, known)
    return out.select(F.col("of").alias(group), "n", "mi")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over a catalogue


def _nearer(points: DataFrame, known: DataFrame, c: str, p: DependenceParams) -> DataFrame:
    """(id, n): how many points of a group lie within ``eps`` of each of ``known`` in one coordinate, itself among them: ranks in sorted blocks."""
    spark = points.sparkSession
    size = max(p.sorted_block, -(-points.count() // p.most_blocks))
    own = points.select("g", F.col(c).alias("v"), "id")
    blocks = materialize(_cut(own.withColumn("key", F.col("g").cast("long")), ["v", "id"], "key", ["v"], size), f"mi-sorted-{c}")
    meta = blocks.select("block", "g", F.element_at("v", 1).alias("lo"), F.element_at("v", -1).alias("hi"), F.size("v").alias("n")).orderBy("g", "block").collect()
    by: dict[int, tuple] = {}
    for r in meta:
        by.setdefault(r["g"], []).append(r)
    held = spark.sparkContext.broadcast({g: (np.array([r["hi"] for r in rs]), np.array([r["block"] for r in rs], np.int64), np.concatenate([[0], np.cumsum([r["n"] for r in rs])])) for g, rs in by.items()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, g, x, eps = (b.column(j).to_numpy() for j in range(4))
            for v in np.unique(g):
                hi, block, before = held.value[v]
                at = np.flatnonzero(g == v)
                for left in (False, True):
                    i = _ranks(hi, x[at], eps[at], left)
                    last = i == len(hi)
                    to = np.where(last, -1, block[np.minimum(i, len(block) - 1)])
                    n = before[i]
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(ids[at]), pa.array(x[at]), pa.array(eps[at]), pa.array(np.full(len(at), left)), pa.array(np.where(left, -n, n))], ["to", "id", "x", "eps", "before", "n"])

    asked = materialize(known.select("id", "g", F.col(c).alias("x"), "eps").mapInArrow(ask, "to long, id long, x double, eps double, before boolean, n long"), f"mi-asked-{c}")
    packed = asked.where("to >= 0").groupBy("to", "before", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.collect_list("id").alias("ids"), F.collect_list("x").alias("xs"), F.collect_list("eps").alias("es"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                left = b.column(0)[i].as_py()
                ids, x, eps, v = (b.column(j)[i].values.to_numpy() for j in range(1, 5))
                n = _ranks(v, x, eps, left)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(left, -n, n).astype(np.int64))], ["id", "n"])

    inside = packed.join(blocks.select(F.col("block").alias("to"), "v"), "to").select("before", "ids", "xs", "es", "v").mapInArrow(answer, "id long, n long")
    return asked.select("id", "n").unionByName(inside).groupBy("id").agg(F.sum("n").alias("n"))
