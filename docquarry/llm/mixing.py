"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over permuted blocks.

Each source's documents are permuted by a hash and cut into blocks of whole documents. A source's target fixes how many times all
of its blocks are drawn (whole passes) and which part of the permutation is drawn once more; block edges fall on the end of that
part, so the block quota is exact. A binary tree over the output shards then splits the quotas of all sources at once: at each
node the left half's share is one multivariate hypergeometric draw. A shard's draws are disjoint stretches of each source's
permuted draws; inside a shard, ``position`` shuffles documents locally.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.ranges import TIE, RangeParams, count_at_most, literal_array, prefix_sums
from docquarry.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """Blocks hold ``block_words``, more where that would make over ``max_blocks`` of them; every source has one or two beside that, so at
    most ``max_blocks`` + 2 edges a source reach the driver. Sources are a catalogue, of at most ``max_sources``. ``runs``: in how many
    sorted stretches a shard is written."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    shards: int = 16
    block_words: int = 50_000
    max_blocks: int = 4096
    max_sources: int = 100_000
    runs: int = 16
    seed: int = 11


def word_count(text: Column) -> Column:
    """Number of maximal runs that are not ASCII white space; null: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...], share: float, most: int) -> list[float]:
    """Shares ``share`` times all sizes by weight; what exceeds ``most`` times a source's size is reshared until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        above = {i for i in free if left * w[i] / total > most * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in above:
            out[i] = float(most * sizes[i])
        left -= most * sum(sizes[i] for i in above)
        free -= above
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard, how many draws of each source it gets: all quotas split exactly, halves by hypergeometric draws."""
    rng = np.random.default_rng(seed)

    def split(left: np.ndarray, n: int) -> list[list[int]]:
        if n == 1:
            return [left.tolist()]
        a = n // 2
        part, rest, need, pool = [], left.copy(), round(int(left.sum()) * a / n), int(left.sum())
        for c in left:
            pool -= int(c)
            got = int(rng.hypergeometric(int(c), pool, need)) if need and int(c) + pool else 0
            part.append(got)
            need -= got
        part = np.array(part, dtype=np.int64)
        return split(part, a) + split(rest - part, n - a)

    return split(np.array(quotas, dtype=np.int64), shards)


def _coprime(n: int, seed: int) -> int:
    a = (seed * 2654435761 + 40503) % max(n, 1) or 1
    while gcd(a, n) != 1:
        a += 1
    return a


@dataclass(frozen=True)
class Mix:
    """What the driver keeps of a plan: one row a source, and one key a block edge."""

    sources: list[dict]
    edges: list[dict]
    edge_ddl: str
    params: MixParams

    def draws(self, df: DataFrame) -> DataFrame:
        """Adds ``__info`` (the source's row) and ``__draws``, an array of (epoch, block, shard, position), by expressions alone.

        ``df`` has ``__rank``, ``__h``, ``__id`` and ``size``; no shuffle, so it runs over rows that carry texts too."""
        if not self.sources:
            return df.withColumns({"__info": F.lit(None).cast(_INFO), "__draws": F.array().cast("array<struct<epoch:int,block:int,shard:int,position:bigint>>")})
        info = F.get(literal_array(self.sources, _INFO), F.col("__rank"))
        key = F.struct(F.col("__rank").alias("r"), F.col("__h").alias("h"), F.col("__id").alias("i"), F.col("size").alias("s"))
        block = count_at_most(literal_array(self.edges, self.edge_ddl), len(self.edges), key) - 1 - F.col("__info")["first_edge"]
        out = _once(df, {"__info": info})
        out = _once(out, {"__block": F.greatest(block, F.lit(0)).cast("int")})
        i, b = F.col("__info"), F.col("__block")

        def draw(e: Column) -> Column:
            p = (i["a"] * (e * i["blocks"] + b) + i["b"]) % i["quota"]
            shard = F.size(F.filter(i["bounds"], lambda x: x <= p))
            pos = F.xxhash64(F.lit(self.params.seed), shard, e, F.col("__h"), F.col("__id"))
            return F.struct(e.alias("epoch"), b.alias("block"), shard.alias("shard"), pos.alias("position"))

        n = i["epochs"] + F.when(b < i["part_blocks"], 1).otherwise(0)
        got = F.when((n > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), n - 1), draw)).otherwise(F.array().cast("array<struct<epoch:int,block:int,shard:int,position:bigint>>"))
        return out.withColumn("__draws", got)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are worked out once a row: the generator keeps the optimiser from copying them into every later use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


_INFO = "struct<source_size:bigint,target:double,epochs:int,part_blocks:int,blocks:int,quota:bigint,a:bigint,b:bigint,first_edge:int,bounds:array<bigint>>"


def _keyed(docs: DataFrame, key: str, text: str, p: MixParams) -> dict[str, Column]:
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return {"size": word_count(F.col(text)), "__h": F.md5(F.concat(F.lit(f"{p.seed}:"), ident)), "__id": F.col(key)}


def _rank(names: list[str | None], source: str) -> Column:
    """Rank of the source in code-point order, null last, by a binary search in the bounded list of names."""
    known = [{"n": x} for x in names if x is not None]
    rank = count_at_most(literal_array(known, "struct<n:string>"), len(known), F.struct(F.col(source).alias("n"))) - 1 if known else F.lit(0)
    return F.when(F.col(source).isNull(), F.lit(len(known))).otherwise(rank).cast("int")


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: MixParams = MixParams(), ranges: RangeParams = RangeParams()) -> tuple[Mix, DataFrame, list]:
    """(the plan, the narrow table of every document's key and size, source names in rank order)."""
    narrow = materialize(docs.select(F.col(source).cast("string").alias("__src"), *[c.alias(k) for k, c in _keyed(docs, key, text, p).items()], F.monotonically_increasing_id().alias(TIE)), "mix-keys")
    per = narrow.groupBy("__src").agg(F.sum("size").alias("s")).orderBy(F.col("__src").asc_nulls_last()).limit(p.max_sources + 1).collect()
    if len(per) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    names, sizes = [r["__src"] for r in per], [int(r["s"] or 0) for r in per]
    narrow = _once(narrow, {"__rank": _rank(names, "__src")})
    if not per:
        return Mix([], [], "", p), narrow, names
    goal = targets(sizes, p.weights, p.share, p.most)
    words = max(p.block_words, ceil(2 * sum(sizes) / p.max_blocks))
    rows, offset = [], 0
    for s, t in zip(sizes, goal):
        e = int(t // s) if s else 0
        rest = t - e * s
        n1 = ceil(rest / words) if rest > 0 else 0
        n2 = ceil((s - rest) / words) if s > rest else 0
        quota = max(1, e * (n1 + n2) + n1)
        rows.append({"source_size": s, "target": t, "epochs": e, "part_blocks": n1, "blocks": n1 + n2, "quota": quota, "rest": rest, "offset": offset, "a": _coprime(quota, p.seed), "b": (p.seed * 7919) % quota})
        offset += s
    order = ["__rank", "__h", "__id", "size", TIE]
    narrow_load = narrow.withColumn("__load", F.col("size") + 16)
    summed = prefix_sums(narrow_load, order, "size", "__load", ranges)
    at = F.get(literal_array(rows, "struct<source_size:bigint,part_blocks:int,blocks:int,rest:double,offset:bigint>"), F.col("__rank"))
    mid = F.col("__cum") - at["offset"] - F.col("size") / 2
    n2 = at["blocks"] - at["part_blocks"]
    block = F.when(mid < at["rest"], F.least(F.floor(mid * at["part_blocks"] / at["rest"]), at["part_blocks"] - 1)).otherwise(
        at["part_blocks"] + F.when(n2 > 0, F.least(F.floor((mid - at["rest"]) * n2 / (at["source_size"] - at["rest"])), n2 - 1)).otherwise(0)
    )
    key_at = F.struct(F.col("__rank").alias("r"), F.col("__h").alias("h"), F.col("__id").alias("i"), F.col("size").alias("s"))
    got = summed.where(F.col("size") > 0).withColumn("__block", block.cast("int")).groupBy("__rank", "__block").agg(F.min(key_at).alias("k")).orderBy("__rank", "__block").collect()
    ddl = f"struct<r:int,h:string,i:{narrow.schema['__id'].dataType.simpleString()},s:bigint>"
    edges, place = [], {}
    for r in got:
        place[(r["__rank"], r["__block"])] = len(edges)
        edges.append(r["k"].asDict())
    # blocks without a document (a document larger than a block) draw nothing: renumber, and the quota follows
    blocks_of: dict[int, list[int]] = {}
    for k, b in place:
        blocks_of.setdefault(k, []).append(b)
    for i, row in enumerate(rows):
        own = sorted(blocks_of.get(i, []))
        row["first_edge"] = place[(i, own[0])] if own else 0
        row["part_blocks"] = sum(b < row["part_blocks"] for b in own)
        row["blocks"] = len(own)
        row["quota"] = max(1, row["epochs"] * row["blocks"] + row["part_blocks"])
        row["a"], row["b"] = _coprime(row["quota"], p.seed), (p.seed * 7919) % row["quota"]
    tree = splitting_tree([r["epochs"] * r["blocks"] + r["part_blocks"] for r in rows], p.shards, p.seed)
    for i, row in enumerate(rows):
        row["bounds"] = np.cumsum([t[i] for t in tree])[:-1].tolist()
    return Mix(rows, edges, ddl, p), narrow, names


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: MixParams = MixParams(), ranges: RangeParams = RangeParams()) -> DataFrame:
    """One row a document: key, size, source_size, target (its source's), taken, draws.

    Size: words between ASCII white space (null text: 0). A document is drawn whole, once a pass, so ``taken`` is 0, 1 or ``most``
    times its size. Null source: a source of its own, last. Equal rows share a fate. A source without words has target 0.
    Empty table: no rows. Other columns are not read.
    """
    plan, narrow, _ = plan_mix(docs, key, text, source, p, ranges)
    d = plan.draws(narrow)
    return d.select(
        F.col("__id").alias(key), "size", F.coalesce(F.col("__info")["source_size"], F.lit(0)).cast("long").alias("source_size"), F.col("__info")["target"].alias("target"),
        (F.col("size") * F.size("__draws")).cast("long").alias("taken"), F.col("__draws").alias("draws"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", p: MixParams = MixParams(), ranges: RangeParams = RangeParams()) -> DataFrame:
    """The mix itself: each document once a draw, whole, with ``docs``' own columns only, dealt to the tree's output shards and shuffled
    inside each: one shuffle by (shard, stretch of positions), then a local sort, so that written files are the shards' stretches in
    order. Null keys and null sources are drawn like any other; documents without words are not drawn; repeated rows are drawn
    alike. Empty table: no rows."""
    plan, _, names = plan_mix(docs, key, text, source, p, ranges)
    inner = {f"__d{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[v.alias(k) for k, v in inner.items()], F.col(f"`{source}`").cast("string").alias("__src"), *[c.alias(k) for k, c in _keyed(docs, key, text, p).items()])
    keyed = keyed.select(*inner, F.inline(F.array(F.struct("__src", "size", "__h", "__id"))))
    drawn = plan.draws(_once(keyed, {"__rank": _rank(names, "__src")})).select(*inner, F.explode("__draws").alias("__draw"))
    placed = drawn.select(*inner, F.col("__draw.shard").alias("__shard"), F.col("__draw.position").alias("__position"))
    # positions are hashes: even cuts of their range are stretches of about one size
    stretch = F.least(F.floor((F.col("__position") / F.lit(2.0**64) + 0.5) * p.runs), F.lit(p.runs - 1))
    dealt = placed.withColumn("__stretch", stretch).repartition(p.shards * p.runs, "__shard", "__stretch").sortWithinPartitions("__shard", "__stretch", "__position")
    return dealt.select(*[F.col(k).alias(c) for k, c in zip(inner, docs.columns)])


def oracle(p: MixParams = MixParams()) -> str:
    """The rows of ``mix_plan`` (size, source_size, target, taken) in SQL: targets in closed form, draws by the same permutation."""
    weight = " ".join(f"when {i} then {w}" for i, w in enumerate(p.weights))
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('{p.seed}:' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % {len(p.weights)} {weight} end as w from d group by source),
o as (select *, row_number() over (order by {p.most} * source_size / w, source nulls last) as r, {p.share} * sum(source_size) over () as total from s),
f as (select *, total - coalesce({p.most} * sum(source_size) over (order by r rows between unbounded preceding and 1 preceding), 0) as left_over, sum(w) over (order by r rows between current row and unbounded following) as ws from o),
g as (select *, left_over * w / ws > {p.most} * source_size as above from f),
first_free as (select min(r) as r from g where not above),
level as (select left_over, ws from g join first_free using (r)),
t as (select source, source_size, case when g.r < (select r from first_free) then ({p.most} * source_size)::double else (select left_over from level)::double * w / (select ws from level) end as target from g),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
c as (select d.*, e.source_size, e.target, e.epochs, target - epochs * e.source_size as rest, sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding) - size / 2.0 as middle from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (epochs + case when middle < rest then 1 else 0 end))::bigint as taken from c"""
