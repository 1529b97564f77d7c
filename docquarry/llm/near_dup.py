"""MinHash near-dedup by a signature-coordinate inverted join.

Each distinct shingle set gets a signature of ``coords`` minima. Sets are posted under each (coordinate, value) pair, and pairs of
sets that meet in at least ``least`` lists are candidates. Merging is by prefix and skip: with lists in one global order, rarest
first, two such sets must meet within the first ``coords - least + 1`` lists of each, so a set's ``least - 1`` most frequent lists
are skipped, and a set that shares fewer than ``least`` lists with anything is dropped before any pair is made. Within a list, sets
are first compared with the best hub of their lists. Groups that this leaves apart are written as differences from a hub of their own,
and an inverted join over the elements of those finds what can still link (``_resolved``): what a group has in common is in no list.
Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.filters import without
from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class NearParams:
    """Link at ``percent`` * union <= 100 * intersection. ``least`` of ``coords``: a pair at 0.8 stays below it about 5 times in a million.

    ``levels`` (at least 1): of hubs that what is left apart is written as differences from; lists of at most ``short_list`` sets are then
    compared pair by pair. ``block``: sets of a tile's side, and ``block_shingles``, for what is left
    after that. ``broadcast_ids``: up to so many candidate ids (16 bytes each) are broadcast to pick their texts; beyond it, by shuffle."""

    words: int = 5
    percent: int = 80
    coords: int = 64
    least: int = 36
    seed: int = 5
    levels: int = 1
    short_list: int = 48
    block: int = 512
    block_shingles: int = 1_000_000
    broadcast_ids: int = 2_000_000


# --- shingles and signatures ------------------------------------------------------------------------------------------------------
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run that is not ASCII white space, A-Z lower-cased) of UTF-8 text, in order."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_SPACE[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    n = end - start
    letters = b[word]
    first = np.cumsum(n) - n
    place = np.arange(len(letters)) - np.repeat(first, n)
    # the place's multiplier times a value of the letter; places beyond the table, and only those, are told apart by their round, so
    # that a word's hash depends on that word alone
    v = _BYTE[letters] * _PLACE[place & 4095]
    far = np.flatnonzero(place > 4095)
    if len(far):
        v[far] = _mix(v[far] + (place[far] >> 12).astype(np.uint64))
    return _mix(np.add.reduceat(_mix(v), first) + n.astype(np.uint64))


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole sequence if it has fewer words; empty without words."""
    h = word_hashes(raw)
    if not len(h):
        return h
    k = min(words, len(h))
    acc = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):
        acc = _mix(acc + h[i : len(h) - k + 1 + i] * np.uint64(2 * i + 3))
    return np.unique(acc)


class Signer:
    def __init__(self, p: NearParams):
        rng = np.random.default_rng(p.seed)
        self.a = (rng.integers(1, 1 << 63, p.coords, dtype=np.uint64) | np.uint64(1))[:, None]
        self.b = rng.integers(1, 1 << 63, p.coords, dtype=np.uint64)[:, None]
        self.at = np.arange(p.coords, dtype=np.uint64) << np.uint64(56)

    def posts(self, s: np.ndarray) -> np.ndarray:
        """One signed 64-bit value a coordinate: the coordinate in the high byte, 56 bits of the minimum's hash below."""
        low = np.full(len(self.a), ~np.uint64(0))
        for i in range(0, len(s), 2048):
            low = np.minimum(low, (self.a * s[None, i : i + 2048] + self.b).min(axis=1))
        return ((_mix(low) >> np.uint64(8)) | self.at).view(np.int64)


def _signed(df: DataFrame, p: NearParams) -> DataFrame:
    """(id, n_shingles, cls, posts) of each row: cls is a digest of the shingle set, null where it is empty."""
    kind = df.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(df.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)
        for b in batches:
            n, cls, posts = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_buffer().to_pybytes(), p.words) if t.is_valid else ()
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                posts.append(signer.posts(s) if len(s) else none)
            ends = np.cumsum([0, *map(len, posts)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *posts])))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), flat], ["id", "n_shingles", "cls", "posts"])

    none = np.empty(0, np.int64)
    return df.mapInArrow(run, f"id {kind}, n_shingles long, cls binary, posts array<bigint>")


# --- links --------------------------------------------------------------------------------------------------------------------------
def _sets(docs: DataFrame, ids: DataFrame, p: NearParams) -> DataFrame:
    """(id, shingles) of the candidates, from their texts."""
    kind = docs.schema["id"].dataType.simpleString()
    small = ids.limit(p.broadcast_ids + 1).count() <= p.broadcast_ids
    picked = docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", p.words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["id", "shingles"])

    sets = materialize(picked.mapInArrow(run, f"id {kind}, shingles binary"), "near-sets")
    return sets if sets.count() == ids.count() else materialize(sets.dropDuplicates(["id"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """Those of ``pairs`` (x, y) whose full shingle sets are similar enough. Each side is joined by shuffle, so a hub's set is sent once
    a partition and a hot hub's pairs are split by the engine's skew handling."""
    kind = pairs.schema["x"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("a")), "x").join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("b")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for a, b in zip(t.column(2), t.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small, big = (a, b) if len(a) < len(b) else (b, a)
                if 100 * len(small) < p.percent * len(big):
                    keep.append(False)
                    continue
                at = np.searchsorted(big, small)
                common = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                keep.append(100 * common >= p.percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return both.select("x", "y", "a", "b").mapInArrow(run, f"x {kind}, y {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable over ``edges`` (x, y), for every id that occurs. Least labels spread along edges, then each
    label is replaced by its own label (so that paths halve); tables are written between rounds, and only counts reach the driver.
    Labels only fall, so it ends."""
    edges = materialize(edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))).distinct(), "cc-edges")
    held = labels = materialize(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("label").alias("next"))
        new = materialize(spread.join(jump, "mid", "left").select("id", "was", F.least("mid", F.coalesce("next", "mid")).alias("label")), "cc-labels")
        moved = new.where(F.col("label") < F.col("was")).limit(1).count()
        discard(held)
        held, labels = new, new.select("id", "label")
        if not moved:
            discard(edges)
            return labels


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (id, weight, comp) after ``links`` (x, y) between ids. Only edges between different components are searched, each once:
    a component's least id is its name, so names of merged components are least ids too."""
    links = materialize(links, "near-links")
    of = lambda k: comps.select(F.col("id").alias(k), F.col("comp").alias(f"c{k}"))
    edges = materialize(links.join(of("x"), "x").join(of("y"), "y").where(F.col("cx") != F.col("cy")).select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).distinct(), "near-edges")
    discard(links)
    if not edges.limit(1).count():
        return comps
    moved = components(edges).withColumnRenamed("id", "comp")
    discard(edges)
    return materialize(comps.join(moved, "comp", "left").select("id", "weight", F.coalesce("label", "comp").alias("comp")), "near-comps")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", p: NearParams = NearParams()) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: component_id is the least key reachable over links, kept marks that row.

    Words: runs that are not ASCII white space, A-Z lower-cased. Equal shingle sets are one class and stand behind its least key. Null
    and empty texts: no shingles, linked with nothing. Null key: linked with nothing, component null, kept. Rows repeated under one
    key are one document. Empty table: no rows. Other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("t"))
    signed = materialize(_signed(own, p), "near-signed")
    linked = signed.where(F.col("cls").isNotNull() & F.col("id").isNotNull())
    classes = materialize(linked.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "near-classes")
    reps = linked.join(classes.select(F.col("rep").alias("id"), "cls"), ["id", "cls"], "left_semi").select("id", "n_shingles", "posts").dropDuplicates(["id"])
    comps = _joined(own, reps, p)
    found = classes.select("cls", "rep", "n")
    if comps is not None:
        found = found.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("cls", F.coalesce("comp", "rep").alias("component"), "n", "rep")
    else:
        found = found.withColumn("component", F.col("rep"))
    moved = found.where((F.col("n") > 1) | (F.col("component") != F.col("rep"))).select("cls", "component")
    out = signed.select("id", "n_shingles", "cls").join(moved, "cls", "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _joined(own: DataFrame, reps: DataFrame, p: NearParams) -> DataFrame | None:
    """(id, weight, comp) of every candidate: its component's least id. None without candidates."""
    posted = reps.select("id", F.explode("posts").alias("list"))
    shared = posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = posted.join(shared, "list")
    # prefix and skip: a set's lists in one global order, rarest first (lists of one set are left out already)
    ranked = (
        met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "list"))).alias("lists"), F.sum("n").alias("weight"))
        .where(F.size("lists") >= p.least)
        .select("id", "weight", F.transform(F.slice("lists", F.lit(1), F.size("lists") - (p.least - 1)), lambda x: x["list"]).alias("prefix"))
    )
    cands = materialize(ranked, "near-prefixes")
    ids = cands.select("id")
    if not ids.limit(1).count():
        return None
    sets = _sets(own, ids, p)
    kept = materialize(cands.select("id", "weight", F.explode("prefix").alias("list")), "near-kept")
    # each set with its best hub: of a list, the set that the most others meet over all its lists, so a group's centre if it has one
    by = lambda order: F.max_by("id", order)
    hubs = kept.groupBy("list").agg(by(F.struct("weight", F.xxhash64("id"))).alias("hub"), F.max("weight").alias("w"), F.count("*").alias("n")).where(F.col("n") > 1)
    first = kept.join(hubs.select("list", "hub", "w"), "list").where(F.col("id") != F.col("hub")).groupBy(F.col("id").alias("x")).agg(F.max_by("hub", F.struct("w", F.xxhash64("hub"))).alias("y"))
    comps = _merged(cands.select("id", "weight", F.col("id").alias("comp")), _confirmed(first, sets, p))
    # what shares a list and isn't joined up yet falls into groups of components: each meets the main one of its lists
    lit = kept.select("list", "id").join(comps.select("id", "comp"), "id").groupBy("list", "comp").agg(F.count("*").alias("n"))
    main = lit.groupBy("list").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where(F.col("comps") > 1)
    meet = materialize(lit.join(main, "list").where(F.col("comp") != F.col("main")).select(F.col("comp").alias("x"), F.col("main").alias("y")).distinct(), "near-meet")
    if not meet.limit(1).count():
        return comps
    groups = comps.join(components(meet).select(F.col("id").alias("comp"), F.xxhash64("label").alias("g")), "comp").select("g", "id")
    return _resolved(materialize(groups, "near-groups"), comps, sets, p)


def _resolved(groups: DataFrame, comps: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """``comps`` after every link inside ``groups`` (g, id) has been found.

    Sets of a group are written as differences from its hub, the elements that most of its sets have: with D the symmetric difference
    and v = (100 + percent) |D| - (100 - percent) |set|, two sets link exactly if v + v' <= 2 (100 + percent) |D and D'|. So what the
    group has in common costs nothing. Sets with v at most minus the group's least v link with the set of that least v; any other
    link between two components needs so many common elements of differences, at least, as follow from v and the least v outside the
    set's component. Prefix and skip over the lists of elements find who may have them. Pairs of short lists are confirmed; sets of
    long lists form the groups of the next level, with a hub of their own. What ``levels`` leave is compared in tiles, of whole groups or
    list by list."""
    kind, unit = comps.schema["id"].dataType.simpleString(), 2 * (100 + p.percent)
    for level in range(p.levels):
        diffs = _differences(groups, comps, sets, p)
        if diffs is None:
            return comps
        least = materialize(diffs.groupBy("g").agg(F.min("v").alias("lowest"), F.min_by("id", F.struct("v", "id")).alias("m")), "near-least")
        close = diffs.select("g", "id", "v").join(least, "g").where((F.col("v") + F.col("lowest") <= 0) & (F.col("id") != F.col("m")))
        comps = _merged(comps, close.select(F.col("id").alias("x"), F.col("m").alias("y")))
        # the least v outside a set's component: the group's, or for the component that has it, the least of all others
        of = comps.select("id", "comp")
        nearest = least.join(of.withColumnsRenamed({"id": "m", "comp": "cm"}), "m").select("g", "lowest", "cm")
        valued = materialize(diffs.select("g", "id", "v").join(of, "id").join(nearest, "g"), "near-valued")
        following = valued.where(F.col("comp") != F.col("cm")).groupBy("g").agg(F.min("v").alias("next"))
        outside = F.when(F.col("comp") == F.col("cm"), F.col("next")).otherwise(F.col("lowest"))
        need = F.greatest(F.ceil((F.col("v") + outside) / unit), F.lit(1)).cast("int").alias("need")
        needs = valued.join(following, "g").select("g", "id", "comp", need)
        items = needs.join(diffs.select("g", "id", "d"), ["g", "id"]).where(F.size("d") >= F.col("need"))
        items = materialize(items.select("g", "id", "comp", "need", F.explode("d").alias("e")), "near-items")
        mine = Window.partitionBy("g", "id")
        ranked = items.join(_mixed(items).select("g", "e", "n"), ["g", "e"]).withColumn("place", F.row_number().over(mine.orderBy("n", "e"))).withColumn("all", F.count("*").over(mine))
        prefix = materialize(ranked.where(F.col("place") <= F.col("all") - F.col("need") + 1).select("g", "id", "comp", "e"), "near-prefixes")
        # lists of the same sets count once
        lists = materialize(_mixed(prefix).groupBy("g", "n", "who").agg(F.min("e").alias("e")).select("g", "e", "n"), "near-lists")
        short = prefix.join(lists.where(F.col("n") <= p.short_list), ["g", "e"]).groupBy("g", "e").agg(F.collect_list(F.struct("id", "comp")).alias("m"))
        pair = F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b["id"] < a["id"]) & (b["comp"] != a["comp"])), lambda b: F.struct(a["id"].alias("x"), b["id"].alias("y"))))))
        comps = _merged(comps, _confirmed(short.select(pair.alias("p")).select("p.x", "p.y").distinct(), sets, p))
        discard(items)
        long = materialize(prefix.join(lists.where(F.col("n") > p.short_list), ["g", "e"]).select("g", "e", "id"), "near-long")
        discard(diffs, prefix, lists)
        groups = materialize(long.select("g", "id").distinct(), "near-groups")
    # whole groups or list by list, whichever sends fewer rows
    sent = F.count("*") * F.ceil(F.count("*") / p.block)
    whole = groups.groupBy("g").agg(sent.alias("whole"))
    listed = long.groupBy("g", "e").agg(sent.alias("n")).groupBy("g").agg(F.sum("n").alias("listed"))
    way = whole.join(listed, "g").select("g", (F.col("listed") < F.col("whole")).alias("by_list"))
    by_list = long.join(way.where("by_list"), "g").select(F.xxhash64("g", "e").alias("g"), "id")
    return _tiled(groups.join(way.where("not by_list"), "g").select("g", "id").unionByName(by_list), comps, sets, kind, p)


def _mixed(posted: DataFrame) -> DataFrame:
    """(g, e, n, who) of the lists that hold sets of more than one component: their length, and a digest of their members."""
    who = F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who")
    return posted.groupBy("g", "e").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), who).where(F.col("lo") != F.col("hi")).select("g", "e", "n", "who")


def _live(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(g, id, comp, n) of the groups that have sets of more than one component."""
    now = groups.join(comps.select("id", "comp"), "id")
    live = now.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where(F.col("lo") != F.col("hi"))
    return materialize(now.join(live.select("g", "n"), "g").select("g", "id", "comp", "n"), "near-live")


def _differences(groups: DataFrame, comps: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame | None:
    """(g, id, v, d) of each set of a group that has more than one component: see ``_resolved``. None without such groups."""
    live = _live(groups, comps)
    if not live.limit(1).count():
        return None
    kind = comps.schema["id"].dataType.simpleString()

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            parts = [np.frombuffer(a.as_buffer(), np.int64) for a in t.column(1)]
            g = np.repeat(t.column(0).to_numpy(), [len(a) for a in parts])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *parts]), pa.int64())], ["g", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v, ds = [], []
            hubs = t.column(3)
            for i, a in enumerate(t.column(2)):
                a = np.frombuffer(a.as_buffer(), np.int64)
                d = np.setxor1d(a, hubs[i].values.to_numpy() if hubs[i].is_valid else none, assume_unique=True)
                v.append((100 + p.percent) * len(d) - (100 - p.percent) * len(a))
                ds.append(d)
            ends = np.cumsum([0, *map(len, ds)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *ds])))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(v, pa.int64()), flat], ["g", "id", "v", "d"])

    none = np.empty(0, np.int64)
    full = live.join(sets, "id")
    common = full.select("g", "shingles").mapInArrow(elements, "g long, e long").groupBy("g", "e").agg(F.count("*").alias("c")).join(live.select("g", "n").distinct(), "g")
    hubs = materialize(common.where(2 * F.col("c") > F.col("n")).groupBy("g").agg(F.collect_list("e").alias("h")), "near-hubs")
    return materialize(full.join(hubs, "g", "left").select("g", "id", "shingles", "h").mapInArrow(run, f"g long, id {kind}, v long, d array<bigint>"), "near-diffs")


def _tiled(groups: DataFrame, comps: DataFrame, sets: DataFrame, kind: str, p: NearParams) -> DataFrame:
    """``comps`` after all sets of each group have been compared, block against block; of a tile only links that join components come out."""
    live = _live(groups, comps)
    sized = live.join(sets.select("id", (F.octet_length("shingles") / 8).alias("size")), "id")
    full = F.greatest(F.count("*") / p.block, F.sum("size") / p.block_shingles)  # a block is bounded in sets and in shingles
    counts = sized.groupBy("g").agg(F.ceil(full).cast("int").alias("blocks"))
    dealt = live.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = dealt.select("g", "id", "comp", "block", other).select("g", "id", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiled = materialize(tiled, "near-tiles")
    if not tiled.limit(1).count():
        return comps
    compare = lambda b: _block_links(b, p)
    return _merged(comps, tiled.join(sets, "id").groupBy("g", "i", "j").applyInPandas(compare, f"x {kind}, y {kind}"))


def _block_links(b: pd.DataFrame, p: NearParams) -> pd.DataFrame:
    """Links between the two blocks of a tile (or inside its only one) that join up components apart so far: intersections of all sets
    at once, as a product of incidence matrices, a stretch of shingles at a time."""
    sets = [np.frombuffer(x, np.uint64) for x in b["shingles"]]
    n = np.array([len(s) for s in sets], np.int64)
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    column = np.cumsum(times > 1)[place[twice]] - 1
    who = who[twice]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[who[x:y], column[x:y] - lo] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    hit = np.triu(100 * both >= p.percent * (n[:, None] + n[None, :] - both), 1)
    comp, ids, root, out = b["comp"].to_numpy(), b["id"].to_numpy(), {}, []

    def top(c: object) -> object:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for i, j in zip(*np.nonzero(hit)):
        u, v = top(comp[i]), top(comp[j])
        if u != v:
            root[u] = v
            out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["x", "y"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", p: NearParams = NearParams()) -> DataFrame:
    """``docs`` with one document, the least key, of each component; their own columns."""
    gone = materialize(near_components(docs, key, text, p).where(~F.col("kept")).select(key), "near-gone")
    return without(docs, gone, key)


def oracle(p: NearParams) -> str:
    """The same by brute force in SQL, for small tables: all pairs that share a shingle, then reachability (document ids distinct)."""
    k, upper = p.words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {k} then list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {p.percent} * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r as (select doc_id as x, doc_id as y from n union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) as component from r group by x)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component, doc_id) as component_id, coalesce(component, doc_id) = doc_id as kept from documents left join n using (doc_id) left join m on m.x = doc_id"""
