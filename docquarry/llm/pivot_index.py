"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, apart from each other, filled up with random directions. A vector is
described by its ``near`` nearest pivots in order and posted in inverted lists of pairs of them; two vectors that meet in a list and share
``shared`` pivots or more are candidates. With pivots in one global order, rarest first, two such vectors share a pair among the first
``near`` - ``shared`` + 2 pivots of each, so only those are posted. Every candidate is verified by its cosine.

Groups of copies never become pairs. Equal vectors are one class. Classes of one permutation prefix that lie within half the linking
angle of the least of them form a ball: all of it is linked, by the triangle inequality of angles, and it is posted as one. A pair of
balls is linked as a whole or not at all where its centres' angle and its radii say so; only others are compared, block by block, and give
up sums of links, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.llm.near_dup import components
from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class PivotParams:
    """Link at a cosine of ``cosine`` or more. ``near``, ``shared``: a pair at 0.95 in 64 dimensions is missed about once in a hundred.

    Pivots: a power of two from ``least_pivots`` to ``most_pivots`` (all of the index that reaches the driver), so that a list holds about
    ``per_list`` posts; sampled ones have cosines below ``apart``. ``block``: members of one side of a comparison."""

    cosine: float = 0.95
    near: int = 8
    shared: int = 3
    least_pivots: int = 256
    most_pivots: int = 8192
    per_list: int = 16
    apart: float = 0.8
    block: int = 256
    seed: int = 12

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)

    @property
    def posted(self) -> int:
        return self.near - self.shared + 2

    def pivots(self, n: int) -> int:
        lists = n * self.posted * (self.posted - 1) / 2 / self.per_list
        return min(self.most_pivots, max(self.least_pivots, 1 << math.ceil(math.log2(max(1.0, math.sqrt(2 * lists))))))


#: Pivots by their last seven bits, as a set in two numbers: few pairs without enough common pivots get past it.
_BITS = ("bits0", "bits1")
#: Angles near 0 come from cosines near 1, with errors of some 1e-8; what is as near to a bound as this is compared exactly.
_SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their size."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(col: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) of a column of packed vectors, for each length."""
    lengths = np.array([len(v.as_buffer()) for v in col]) if len(col) else np.empty(0, int)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(col[i].as_buffer() for i in at.tolist()), kind).reshape(len(at), -1)


def _pivots(vectors: DataFrame, width: int, n: int, p: PivotParams) -> np.ndarray:
    """The pivots, as rows of ``width``: of vectors in the order of a hash, those that are apart from all before; then random ones."""
    m = p.pivots(n)
    got = vectors.select("id", "v").orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(2 * m).collect()
    out = np.zeros((m, width))
    have = 0
    for r in got:
        if have == m:
            break
        v = np.zeros(width)
        v[: len(r["v"])] = _unit(np.array([r["v"]]))[0]
        if not have or (out[:have] @ v).max() < p.apart:
            out[have] = v
            have += 1
    out[have:] = _unit(np.random.default_rng(p.seed).normal(size=(m - have, width))) if have < m else 0
    return out


def _described(vectors: DataFrame, pivots: np.ndarray, kind: str, p: PivotParams) -> DataFrame:
    """(id, m, dim, nearest, bits, data) of every class: its nearest pivots in order and as a set, and its vector packed."""
    id_kind = vectors.schema["id"].dataType
    id_arrow = to_arrow_type(id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.T.astype(np.float32)
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for lo in range(0, len(at), 1024):
                    part = b.take(pa.array(at[lo : lo + 1024]))
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    dots = _unit(x).astype(np.float32) @ points[:dim]
                    top = np.argpartition(-dots, p.near, axis=1)[:, : p.near]
                    order = np.lexsort((top, -np.take_along_axis(dots, top, 1)), axis=1)
                    top = np.take_along_axis(top, order, 1).astype(np.int32)
                    n = part.num_rows
                    near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.near), pa.array(top.ravel()))
                    bits = [pa.array(np.bitwise_or.reduce(np.where(top >> 6 & 1 == h, np.uint64(1) << (top & 63).astype(np.uint64), np.uint64(0)), axis=1).view(np.int64)) for h in (0, 1)]
                    data = pa.array([r.tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(id_arrow), part.column(1), pa.array(np.full(n, dim, np.int32)), near, *bits, data], ["id", "m", "dim", "nearest", *_BITS, "data"])

    return vectors.select("id", "m", "v").mapInArrow(run, f"id {id_kind.simpleString()}, m long, dim int, nearest array<int>, bits0 long, bits1 long, data binary")


def _cosines(pairs: DataFrame, packed: DataFrame, kind: str) -> DataFrame:
    """(x, y, cosine) of ``pairs`` (x, y). Each side's vectors are joined by shuffle, which splits what many pairs share."""
    id_kind = pairs.schema["x"].dataType.simpleString()
    both = pairs.join(packed.select(F.col("id").alias("x"), F.col("data").alias("a")), "x").join(packed.select(F.col("id").alias("y"), F.col("data").alias("b")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = np.zeros(b.num_rows)
            for (at, x), (_, y) in zip(_rows(b.column(2), kind), _rows(b.column(3), kind)):
                cosine[at] = (_unit(x) * _unit(y)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosine)], ["x", "y", "cosine"])

    return both.select("x", "y", "a", "b").mapInArrow(run, f"x {id_kind}, y {id_kind}, cosine double")


def _balls(described: DataFrame, kind: str, p: PivotParams) -> DataFrame:
    """(id, m, dim, ball, off) of every class: the least id of its ball, and its angle to that one; classes alone are balls of their own."""
    first = F.struct(F.array_sort(F.slice("nearest", 1, 2)).alias("two"), "dim").alias("prefix")
    narrow = described.select("id", first, "nearest")
    # written, so that the join has a shuffle of its own on each side, and a prefix that many share is split
    centres = materialize(narrow.groupBy("prefix").agg(F.min(F.struct("id", "nearest")).alias("c"), F.count("*").alias("n")).where("n > 1").select("prefix", "c"), "pivot-centres")
    # of those that share a prefix by chance, most have no more in common
    close = F.size(F.array_intersect("nearest", "c.nearest")) > p.shared
    pairs = narrow.join(centres, "prefix").where((F.col("id") != F.col("c.id")) & close).select(F.col("id").alias("x"), F.col("c.id").alias("y"))
    held = _cosines(pairs, described, kind).select("x", F.col("y").alias("centre"), F.acos(F.least("cosine", F.lit(1.0))).alias("angle")).where(F.col("angle") <= p.angle / 2 - _SLACK)
    out = described.select("id", "m", "dim").join(held.withColumnRenamed("x", "id"), "id", "left")
    out = materialize(out.select("id", "m", "dim", F.coalesce("centre", "id").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("off")), "pivot-balls")
    discard(centres)
    return out


def _met(described: DataFrame, balls: DataFrame, sizes: DataFrame, n_pivots: int, p: PivotParams) -> DataFrame:
    """(x, y): pairs of balls that meet in a list of the index, each once. Balls of one class must share ``shared`` pivots."""
    counted = described.select(F.explode("nearest").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n")).collect()
    rank = np.zeros(n_pivots, np.int64)
    for place, (_, pivot) in enumerate(sorted((r["n"], r["pivot"]) for r in counted)):
        rank[pivot] = place
    ranks = F.from_json(F.lit(str(rank.tolist())), "array<int>")
    # a pivot and its rank name each other, so lists of ranks do
    ordered = F.array_sort(F.transform("nearest", lambda k: F.get(ranks, k)))
    own = described.select("id", "dim", ordered.alias("pivots"), *_BITS).join(balls.select("id", "ball"), "id").join(sizes.select("ball", "n"), "ball")
    at = lambda i: F.get("pivots", i).cast("long")
    lists = F.array(*(at(i) * n_pivots + at(j) for i in range(p.posted) for j in range(i + 1, p.posted)))
    alone = F.col("n") == 1
    bits = [F.when(alone, F.col(b)).alias(b) for b in _BITS]
    posts = materialize(own.select(F.explode(lists).alias("list"), "dim", "ball", F.when(alone, F.col("pivots")).alias("pivots"), *bits).distinct(), "pivot-posts")
    full = posts.join(posts.groupBy("list", "dim").agg(F.count("*").alias("n")).where("n > 1").select("list", "dim"), ["list", "dim"], "left_semi")
    a, b = full.alias("a"), full.alias("b")
    overlap = sum((F.bit_count(F.col(f"a.{c}").bitwiseAND(F.col(f"b.{c}"))) for c in _BITS), F.lit(0))
    both = (overlap >= p.shared) & (F.size(F.array_intersect("a.pivots", "b.pivots")) >= p.shared)
    meets = F.col("a.pivots").isNull() | F.col("b.pivots").isNull() | both
    same = (F.col("a.list") == F.col("b.list")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.ball") < F.col("b.ball"))
    met = materialize(a.join(b, same & meets).select(F.col("a.ball").alias("x"), F.col("b.ball").alias("y")).distinct(), "pivot-met")
    discard(posts)
    return met


def _compared(pairs: DataFrame, described: DataFrame, balls: DataFrame, sizes: DataFrame, kind: str, p: PivotParams) -> DataFrame:
    """(x, y, id, links) of ``pairs`` (x, y) of balls, compared member by member: how many vectors of the other ball each links with.
    Members come in blocks of bounded size; a pair of blocks is one row, and gives a row a linked member at most."""
    id_kind = balls.schema["id"].dataType
    asked = pairs.select(F.explode(F.array("x", "y")).alias("ball")).distinct().join(sizes.select("ball", "n"), "ball")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / p.block)).alias("part")
    packed = balls.join(asked, "ball").select("ball", "id", "m", part).join(described.select("id", "data"), "id")
    blocks = materialize(packed.groupBy("ball", "part").agg(F.collect_list(F.struct("id", "m", "data")).alias("of")), "pivot-blocks")
    side = lambda k: blocks.select(F.col("ball").alias(k), *(F.col(f"of.{c}").alias(f"{k}_{c}") for c in ("id", "m", "data")))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")
    id_arrow = to_arrow_type(id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                (ids, m, x), (jds, k, y) = ((t.column(c)[i].values, t.column(c + 1)[i].values.to_numpy(), t.column(c + 2)[i].values) for c in (2, 5))
                x, y = (_unit(next(_rows(z, kind))[1]) for z in (x, y))
                hit = x @ y.T >= p.cosine
                links = np.concatenate([hit @ k, hit.T @ m])
                some = pa.array(links > 0)
                each = pa.chunked_array([ids.cast(id_arrow), jds.cast(id_arrow)]).combine_chunks().filter(some)
                one = [pa.array([t.column(c)[i].as_py()] * len(each), id_arrow) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*one, each, pa.array(links).filter(some)], ["x", "y", "id", "links"])

    cols = ["x", "y", *(f"{k}_{c}" for k in "xy" for c in ("id", "m", "data"))]
    kind_ = id_kind.simpleString()
    return materialize(both.select(*cols).mapInArrow(run, f"x {kind_}, y {kind_}, id {kind_}, links long"), "pivot-compared")


def _linked(described: DataFrame, kind: str, n_pivots: int, p: PivotParams) -> DataFrame:
    """(id, links, component) of the classes that share a ball or link with another one: ``links`` counts vectors, its own copies too."""
    balls = _balls(described, kind, p)
    sizes = materialize(balls.groupBy("ball").agg(F.sum("m").alias("weight"), F.max("off").alias("radius"), F.count("*").alias("n")), "pivot-sizes")
    met = _met(described, balls, sizes, n_pivots, p)
    of = lambda k: sizes.select(F.col("ball").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("weight", "radius", "n")))
    told = materialize(_cosines(met, described, kind).join(of("x"), "x").join(of("y"), "y"), "pivot-told")
    angle, spread = F.acos(F.least("cosine", F.lit(1.0))), F.col("x_radius") + F.col("y_radius")
    single = (F.col("x_n") == 1) & (F.col("y_n") == 1)
    whole = F.when(single, F.col("cosine") >= p.cosine).otherwise(angle + spread <= p.angle - _SLACK)
    sure = told.where(whole)
    open_ = told.where(~single & ~whole & (angle - spread <= p.angle + _SLACK)).select("x", "y")
    compared = _compared(open_, described, balls, sizes, kind, p)
    edges = materialize(sure.select("x", "y").unionByName(compared.select("x", "y").distinct()), "pivot-edges")
    label = components(edges).select(F.col("id").alias("ball"), "label")
    by_ball = sure.select(F.col("x").alias("ball"), F.col("y_weight").alias("w")).unionByName(sure.select(F.col("y").alias("ball"), F.col("x_weight").alias("w"))).groupBy("ball").agg(F.sum("w").alias("sure"))
    by_id = compared.groupBy("id").agg(F.sum("links").alias("open"))
    known = sizes.join(label, "ball", "left").where((F.col("n") > 1) | F.col("label").isNotNull()).join(by_ball, "ball", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = balls.select("id", "ball").join(known, "ball").join(by_id, "id", "left")
    out = materialize(out.select("id", (F.col("weight") + zero("sure") + zero("open")).alias("links"), F.coalesce("label", "ball").alias("component")), "pivot-linked")
    discard(balls, sizes, met, told, compared, edges)
    return out


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", p: PivotParams = PivotParams()) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: how many other vectors it links with directly, the least key reachable over links
    (its own included), and whether that is its own.

    Null vectors, empty ones, those with a null or non-finite component or of zeros alone: linked with nothing. So are vectors of
    different lengths. Null key: no links, component null, kept. Rows of one key are one vector, the one with the least hash if they
    differ. Cosines are of doubles. Empty table: no rows. Other columns are not read."""
    ship_package(vectors.sparkSession)
    kind = "f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "f8"
    cast = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if kind == "f4" else "array<double>").alias("v"))
    sound: Column = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    hashed = F.struct(F.xxhash64(F.lit(p.seed), "v").alias("a"), F.xxhash64(F.lit(p.seed + 1), "v").alias("b"))
    own = cast.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    keyed = materialize(own.groupBy("id").agg(F.min(hashed).alias("hash"), F.max(F.size("v")).alias("dim")), "pivot-keys")
    classes = materialize(keyed.groupBy("hash").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.max("dim").alias("dim")), "pivot-classes")
    n, width = classes.agg(F.count("*"), F.max("dim")).first()
    none = cast.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return none
    reps = classes.select(F.col("rep").alias("id"), "hash", "m")
    reading = own.withColumn("hash", hashed).join(reps, ["id", "hash"]).select("id", "m", "v")
    pivots = _pivots(reading, width, n, p)
    described = materialize(_described(reading, pivots, kind, p), "pivot-described")
    if described.count() != n:  # repeated rows
        twice, described = described, materialize(described.dropDuplicates(["id"]), "pivot-described")
        discard(twice)
    linked = _linked(described, kind, len(pivots), p)
    copied = classes.where("m > 1").select("hash", "rep", "m")
    # every key that has a link: its class's links and component; keys of classes of copies come through their hash
    of = linked.select(F.col("id").alias("rep"), "links", "component")
    one = keyed.join(copied.select("hash"), "hash", "left_anti").select("id", F.col("id").alias("rep")).join(of, "rep").select("id", "links", "component")
    many = keyed.join(copied, "hash").join(of, "rep", "left").select("id", F.coalesce("links", "m").alias("links"), F.coalesce("component", "rep").alias("component"))
    found = one.unionByName(many).select(F.col("id").alias("of"), "links", "component")
    out = cast.select("id").join(found, F.col("id") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    discard(described)
    return out.select(F.col("id").alias(key), F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def oracle(p: PivotParams = PivotParams()) -> str:
    """The same by brute force in SQL, for small tables of vectors of one length with distinct ids."""
    return f"""
with recursive v as materialized (select vec_id, list_transform(embedding::double[], lambda x: x / len) as e from (select vec_id, embedding, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as len from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0) where len > 0),
l as materialized (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id < b.vec_id where list_dot_product(a.e, b.e) >= {p.cosine}),
e as (select x, y from l union all select y, x from l),
n as (select x, count(*) as n from e group by x),
r as (select vec_id as x, vec_id as y from v union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) as component from r group by x)
select vec_id, coalesce(n.n, 0) as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept from embeddings left join n on n.x = vec_id left join m on m.x = vec_id"""
