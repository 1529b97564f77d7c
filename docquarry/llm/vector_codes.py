"""Vector code compression: product codes whose codebooks are fitted by ``treeAggregate`` over columnar blocks.

Vectors become integers and are written in blocks, column by column, in the narrowest type that holds them. Every round is one
``treeAggregate`` over the blocks: squared distances of a part to all entries of its codebook accumulate dimension by dimension,
``np.add.at`` adds the parts to integer sum and count tensors, and the tensors (parts x entries x dimensions of a part, whatever the
number of vectors) merge through a reduction tree. Only those tensors and the codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class CodeParams:
    """``parts`` codebooks of at most ``entries`` (256 at most), fitted in ``rounds``; components are floors of ``scale`` times the value.

    ``block``: vectors of a block. ``depth``: of the reduction tree. ``broadcast_labels``: up to so many labels' sums are broadcast."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    block: int = 2048
    depth: int = 2
    broadcast_labels: int = 1_000_000


#: Blocks' types, narrowest first, and what the integers in them may reach; beyond the last, values are kept as they are ("raw").
_TYPES = ((np.int8, 1 << 7), (np.int16, 1 << 15), (np.int32, 1 << 25))
_LONGEST = (1 << 63) - 1


def _floors(x: np.ndarray, scale: int) -> np.ndarray:
    """Python integers floor(scale * x), exact for every finite double."""
    out = [int(np.floor(v * scale)) if abs(v) < 2.0**900 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(out, object).reshape(x.shape)


def _blocks(kept: DataFrame, p: CodeParams) -> DataFrame:
    """(dim, n, top, kind, ids, labels, data): blocks of vectors of one length; ``data`` holds one column of integers after the other."""
    id_type, label_type = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    schema = f"dim int, n int, top double, kind string, ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>, data binary"
    id_arrow, label_arrow = to_arrow_type(id_type), to_arrow_type(label_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for lo in range(0, len(at), p.block):
                    part = b.take(pa.array(at[lo : lo + p.block]))
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim).T
                    top = float(np.abs(x).max(initial=0)) * p.scale + 1
                    found = [t for t, most in _TYPES if top < most]
                    data, kind = (np.floor(x * p.scale).astype(found[0]), np.dtype(found[0]).str) if found else (x, "raw")
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i).cast(t)) for i, t in ((0, id_arrow), (1, label_arrow))]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([top]), pa.array([kind]), *lists, pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())], ["dim", "n", "top", "kind", "ids", "labels", "data"])

    return kept.mapInArrow(run, schema)


@dataclass(frozen=True)
class _Shape:
    """How vectors of ``dim`` components of at most ``top`` are cut: parts are padded with zeros to ``width`` if they don't divide the
    vector. Distances are in 32 bits if they fit; where squared distances or sums could leave 64 bits, in Python's integers."""

    dim: int
    width: int
    parts: int
    top: float
    scale: int

    @property
    def whole(self) -> type:
        if self.top >= _TYPES[-1][1]:
            return object
        return np.int32 if 4 * self.top * self.top * self.width < 1 << 31 else np.int64

    def load(self, data: bytes, kind: str, n: int) -> np.ndarray:
        """parts x width x n integers."""
        flat = np.frombuffer(data, np.float64 if kind == "raw" else np.dtype(kind)).reshape(self.dim, n)
        whole = _floors(flat, self.scale) if kind == "raw" else flat.astype(self.whole)
        out = np.zeros((self.parts * self.width, n), whole.dtype)
        out[: self.dim] = whole
        return out.reshape(self.parts, self.width, n)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each of n parts: ``x`` is width x n, ``book`` entries x width."""
    far = np.zeros((len(book), x.shape[1]), x.dtype)
    for d in range(len(x)):
        step = x[d][None, :] - book[:, d][:, None]
        far += step * step
    best = far.argmin(axis=0)  # the lowest index of equal ones
    return best, far[best, np.arange(x.shape[1])].astype(object if x.dtype == object else np.int64)


def _fitted(blocks: DataFrame, books: np.ndarray, shape: _Shape, p: CodeParams) -> np.ndarray:
    """The codebooks (parts x entries x width) after ``rounds`` of assignment and replacement."""
    parts, entries, width = books.shape
    wide = object if books.dtype == object else np.int64
    rdd = blocks.select("data", "kind", "n").rdd
    for _ in range(p.rounds):
        now = books

        def add(acc: tuple | None, row: tuple, now: np.ndarray = now) -> tuple:
            sums, counts = acc or (np.zeros((parts, width, entries), wide), np.zeros((parts, entries), np.int64))
            x = shape.load(bytes(row[0]), row[1], row[2])
            for k in range(parts):
                best, _ = _nearest(x[k], now[k])
                np.add.at(counts[k], best, 1)
                for d in range(width):
                    np.add.at(sums[k, d], best, x[k, d].astype(wide))
            return sums, counts

        def merge(a: tuple | None, b: tuple | None) -> tuple | None:
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        sums, counts = rdd.treeAggregate(None, add, merge, p.depth)
        used = counts > 0
        books = books.copy()
        books[used] = (sums.transpose(0, 2, 1)[used] // counts[used][:, None].astype(wide)).astype(books.dtype)
    return books


def _coded(blocks: DataFrame, books: np.ndarray, shape: _Shape) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    id_type, label_type = blocks.schema["ids"].dataType.elementType, blocks.schema["labels"].dataType.elementType
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, kind, n, ids, labels in zip(*(b.column(i) for i in range(5))):
                x = shape.load(data.as_py(), kind.as_py(), n.as_py())
                error, code = 0, []
                for k in range(shape.parts):
                    best, far = _nearest(x[k], books[k])
                    error = error + far
                    code.append(digits[best])
                text = ["".join(c) for c in zip(*code)]
                total = [min(int(e), _LONGEST) for e in error]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text, pa.string()), pa.array(total, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.select("data", "kind", "n", "ids", "labels").mapInArrow(run, f"vec_id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", p: CodeParams = CodeParams()) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector.

    Null vectors and those with a null or non-finite component are left out. All others count, repeated rows and null keys (which come
    last in the order of keys) too; rows of one key are ordered by their vectors. Vectors of another length than the most frequent one
    (of equally frequent ones, the longest) can't be cut alike and are left out too. Parts that don't divide the length are padded with
    zeros. Fewer vectors than entries: smaller codebooks. Integers are exact at any size; an error beyond 64 bits becomes the largest
    long. Null labels are one label. Empty table: no rows. Other columns are not read."""
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    kept = own.where(F.col("v").isNotNull() & finite)
    blocks = materialize(_blocks(kept, p), "codes-blocks")
    most = blocks.groupBy("dim").agg(F.sum("n").alias("n"), F.max("top").alias("top")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = f"`{key}` {own.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if most is None:
        return spark.createDataFrame([], schema)
    dim = most["dim"]
    shape = _Shape(dim, -(-dim // p.parts), p.parts, most["top"], p.scale)
    first = kept.where(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(p.entries).collect()
    start = np.array([r["v"] for r in first], np.float64).reshape(len(first), dim)
    books = np.zeros((len(first), shape.parts * shape.width), shape.whole)
    books[:, :dim] = _floors(start, p.scale) if shape.whole is object else np.floor(start * p.scale)
    same = blocks.where(F.col("dim") == dim)
    books = _fitted(same, books.reshape(len(first), shape.parts, shape.width).transpose(1, 0, 2), shape, p)
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    coded = materialize(_coded(same, books, shape), "codes")
    discard(blocks)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "codes-labels")
    small = sums.limit(p.broadcast_labels + 1).count() <= p.broadcast_labels
    out = coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(p: CodeParams = CodeParams()) -> str:
    """The same in SQL, for small tables of vectors of one length that ``parts`` divides."""
    rounds = ""
    for i in range(p.rounds + 1):
        rounds += f"""
d{i} as materialized (select v.i, v.part, v.x, c.entry, sum((list_extract(v.x, k) - list_extract(c.x, k)) ** 2)::bigint as far from v join c{i} c using (part), (select unnest(range(1, (select any_value(len(x)) from v) + 1)) as k) group by all),
a{i} as materialized (select i, part, x, arg_min(entry, (far, entry)) as entry, min(far) as far from d{i} group by all),"""
        if i < p.rounds:
            rounds += f"""
m{i} as materialized (select part, entry, list(s order by k) as x from (select part, entry, k, floor(sum(list_extract(x, k))::hugeint / count(*))::bigint as s from a{i}, (select unnest(range(1, (select any_value(len(x)) from v) + 1)) as k) group by all) group by all),
c{i + 1} as materialized (select part, entry, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (part, entry)),"""
    last = p.rounds
    return f"""
with kept as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as i, vec_id, label, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select i, part, list_transform(e[part * (len(e) // {p.parts}) + 1:(part + 1) * (len(e) // {p.parts})], lambda x: floor({p.scale} * x)::bigint) as x from kept, range({p.parts}) r(part)),
c0 as materialized (select part, i as entry, x from v where i < {p.entries}),{rounds}
book as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from c{last}),
o as (select i, string_agg(printf('%02x', entry), '' order by part) as code, sum(far)::bigint as error from a{last} group by i)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from o join kept using (i), book"""
