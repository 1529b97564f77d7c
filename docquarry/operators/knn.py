"""Exact nearest-neighbour search that skips blocks by the triangle inequality.

``build`` draws pivots from the vectors, gives each row to its nearest pivot's cell and cuts cells into rings: blocks of rows at about one
distance from the pivot. Of a block, its cell and its rows' least and greatest distances to the pivot are known, and bound what any
query's distance to its rows can be. ``search`` runs in two passes: queries, packed by cell, first read their most promising blocks, whose
k-th distance is an upper bound; then only the blocks whose lower bound doesn't exceed it. All other pairs of a pack of queries and a block
are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.operators.retrieval import top_k
from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class KnnParams:
    """``most_pivots`` and ``most_blocks`` bound what the driver and each task hold of an index; blocks grow beyond ``block`` rows to keep
    the latter. ``pack``: queries of one pack. ``probe``: blocks that a query reads in the first pass, more if they hold under k rows."""

    least_pivots: int = 16
    most_pivots: int = 1024
    block: int = 1024
    most_blocks: int = 1 << 20
    pack: int = 1024
    probe: int = 2


#: Bounds come from rounded distances; a block as near to its bound as this is read.
_SLACK = 1e-5


@dataclass(frozen=True)
class KnnIndex:
    """``blocks``, written: (block, cell, lo, hi, n, ids, data), ids and rows of a block in data's order; ``pivots``, one row each."""

    blocks: DataFrame
    pivots: np.ndarray
    kind: str
    params: KnnParams

    def discard(self) -> None:
        discard(self.blocks)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``y``."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", p: KnnParams = KnnParams()) -> KnnIndex:
    """An index of all rows. Null vectors and those of another length than the most frequent one are left out: they have no distance.

    Rows are shuffled once, by range of (cell, distance, key), which splits a cell however many rows it has."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("v") == dim)
    m = min(p.most_pivots, max(p.least_pivots, 1 << int(np.ceil(np.log2(max(1.0, n**0.5 / 2))))))
    drawn = rows.orderBy(F.xxhash64("k"), "k").limit(m).select("v").collect()
    pivots = np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), dim)
    size = max(p.block, -(-n // p.most_blocks))
    kind, key_type = vectors.schema[key].dataType.simpleString(), to_arrow_type(vectors.schema[key].dataType)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                d = _distances(x, pivots)
                cell = d.argmin(axis=1)
                off = np.sqrt(d[np.arange(len(x)), cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(off), b.column(0).cast(key_type), pa.array([r.tobytes() for r in x], pa.binary())], ["cell", "off", "k", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, pa.Array, list[bytes]]] = []

        def made() -> pa.RecordBatch:
            off = np.concatenate([h[1] for h in held])
            ids = pa.chunked_array([h[2] for h in held]).combine_chunks()
            data = b"".join(x for h in held for x in h[3])
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([off.min()]), pa.array([off.max()]), pa.array([len(ids)], pa.int32()), one, pa.array([data], pa.binary())], ["cell", "lo", "hi", "n", "ids", "data"])

        for b in batches:
            cell, off = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = 0
            while at < len(cell):
                room = size - sum(len(h[1]) for h in held)
                if held and (cell[at] != held[0][0] or not room):
                    yield made()
                    held, room = [], size
                end = min(at + room, int(np.searchsorted(cell, cell[at], "right")))
                part = b.slice(at, end - at)
                held.append((int(cell[at]), off[at:end], part.column(2).cast(key_type), part.column(3).to_pylist()))
                at = end
        if held:
            yield made()

    dealt = rows.mapInArrow(assign, f"cell int, off double, k {kind}, data binary").repartitionByRange("cell", "off", "k").sortWithinPartitions("cell", "off", "k")
    blocks = dealt.mapInArrow(pack, f"cell int, lo double, hi double, n int, ids array<{kind}>, data binary").withColumn("block", F.monotonically_increasing_id())
    return KnnIndex(materialize(blocks, "knn-blocks"), pivots, kind, p)


class _Bounds:
    """Lower bounds of queries' distances to the rows of every block: from the ring that holds them, and from the plane between the
    query's own cell and theirs."""

    def __init__(self, pivots: np.ndarray, block: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray):
        self.pivots, self.block, self.cell, self.lo, self.hi, self.n = pivots, block, cell, lo, hi, n
        self.apart = np.sqrt(_distances(pivots, pivots))

    def of(self, x: np.ndarray) -> np.ndarray:
        d = np.sqrt(_distances(x, self.pivots))
        own = d.argmin(axis=1)
        here = d[np.arange(len(x)), own]
        gap = self.apart[own]
        plane = np.where(gap > 0, (d * d - (here * here)[:, None]) / (2 * np.where(gap > 0, gap, 1)), 0)
        mine = d[:, self.cell]
        return np.maximum(np.maximum(mine - self.hi, self.lo - mine), np.maximum(plane[:, self.cell], 0))

    def first(self, bounds: np.ndarray, k: int, probe: int) -> np.ndarray:
        """Which blocks each query reads first: those of the least bounds, ``probe`` and as many as hold ``k`` rows."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        take = (np.arange(order.shape[1]) < probe) | (before < k)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, take, axis=1)
        return out


def _packed(queries: DataFrame, bounds: object, index: KnnIndex, k: int, second: bool) -> DataFrame:
    """(block, qs, qm, most): for each pack of queries and each block that some of them must read, those queries. First pass: their most
    promising blocks. ``second``: with an upper bound ``most`` for each query, all others whose lower bound doesn't exceed it."""
    p, q_kind = index.params, queries.schema["q"].dataType.simpleString()
    q_type = to_arrow_type(queries.schema["q"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = bounds.value
        step = max(1, min(p.pack, 4_000_000 // max(1, len(b_.block))))
        for b in batches:
            for at in range(0, b.num_rows, p.pack):
                part = b.slice(at, min(p.pack, b.num_rows - at))
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1)
                most = np.sqrt(part.column(2).to_numpy(zero_copy_only=False)) if second else np.zeros(len(x))
                wants = []
                for lo in range(0, len(x), step):
                    low = b_.of(x[lo : lo + step])
                    first = b_.first(low, k, p.probe)
                    wants.append(~first & (low <= most[lo : lo + step, None] + _SLACK) if second else first)
                want = np.concatenate(wants)
                for j in np.flatnonzero(want.any(axis=0)).tolist():
                    i = np.flatnonzero(want[:, j])
                    ids = pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), part.column(0).take(pa.array(i)).cast(q_type))
                    upper = pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), pa.array(most[i] ** 2))
                    yield pa.RecordBatch.from_arrays([pa.array([int(b_.block[j])], pa.int64()), ids, pa.array([x[i].tobytes()], pa.binary()), upper], ["block", "qs", "qm", "most"])

    return queries.mapInArrow(run, f"block long, qs array<{q_kind}>, qm binary, most array<double>")


def _nearest(packs: DataFrame, index: KnnIndex, k: int, digits: int, bounded: bool) -> DataFrame:
    """(query_id, k, distance): of each pack and block that met, each query's ``k`` nearest rows, within its bound if ``bounded``."""
    q_kind = packs.schema["qs"].dataType.elementType.simpleString()
    both = packs.join(index.blocks.select("block", "ids", "data"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                qs, ids = t.column(0)[i].values, t.column(3)[i].values
                x, y = (np.frombuffer(t.column(c)[i].as_buffer(), np.float64).reshape(len(n), -1) for c, n in ((1, qs), (4, ids)))
                d = np.round(_distances(x, y), digits)
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                if bounded:
                    edge = np.minimum(edge, t.column(2)[i].values.to_numpy() + _SLACK)
                a, b = np.nonzero(d <= edge[:, None])
                rank = np.asarray(ids.to_pylist())
                order = np.lexsort((rank[b], d[a, b], a))
                a, b = a[order], b[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(a)), ids.take(pa.array(b)), pa.array(d[a, b])], ["query_id", "k", "distance"])

    return both.select("qs", "qm", "most", "ids", "data").mapInArrow(run, f"query_id {q_kind}, k {index.kind}, distance double")


@dataclass(frozen=True)
class Searched:
    """``rows`` (query_id, key, distance, rank), and how many pairs of a pack of queries and a block there are and were read."""

    rows: DataFrame
    pairs: int
    read: int


def search(index: KnnIndex, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> Searched:
    """The ``k`` nearest rows of each query (query_id, vector) by squared distance (rounded, so that equal ones tie), then key. Exact.
    Queries without a vector, or of another length than the index's, have no rows. Nothing about queries or rows reaches the driver
    but the blocks' bounds, at most ``most_blocks`` of them."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark, p = queries.sparkSession, index.params
    ship_package(spark)
    dim = index.pivots.shape[1]
    meta = index.blocks.select("block", "cell", "lo", "hi", "n").orderBy("block").collect()
    of = lambda c, t: np.array([r[c] for r in meta], t)
    bounds = spark.sparkContext.broadcast(_Bounds(index.pivots, of("block", np.int64), of("cell", np.int64), of("lo", float), of("hi", float), of("n", np.int64)))
    pivots = index.pivots
    q_kind, q_type = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                cell = _distances(x, pivots).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(q_type), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell)], ["q", "data", "cell"])

    asked = queries.where(F.size(vector) == dim).select(F.col("query_id").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    if not meta:
        asked = asked.limit(0)
    celled = materialize(asked.mapInArrow(assign, f"q {q_kind}, data binary, cell int").repartitionByRange("cell", "q").sortWithinPartitions("cell", "q"), "knn-queries")
    packs = materialize(_packed(celled.select("q", "data"), bounds, index, k, False), "knn-first")
    near = materialize(_nearest(packs, index, k, digits, False), "knn-near")
    kth = top_k(near, k, "query_id", F.col("distance").asc(), F.col("k").asc()).groupBy(F.col("query_id").alias("of")).agg(F.max("distance").alias("most"), F.count("*").alias("n"))
    most = F.when(F.col("n") == k, F.col("most")).otherwise(F.lit(float("inf")))
    bounded = celled.join(kth, F.col("q") == F.col("of")).sortWithinPartitions("cell", "q").select("q", "data", most.alias("most"))
    rest = materialize(_packed(bounded, bounds, index, k, True), "knn-second")
    more = _nearest(rest, index, k, digits, True)
    rows = top_k(near.unionByName(more), k, "query_id", F.col("distance").asc(), F.col("k").asc()).withColumnRenamed("k", key)
    total = -(-celled.count() // p.pack) * len(meta)
    return Searched(rows, total, packs.count() + rest.count())


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6, p: KnnParams = KnnParams()) -> DataFrame:
    """``search`` in a fresh index of ``vectors``."""
    return search(build(vectors, key, vector, p), queries, k, key, vector, digits).rows
