"""Conversation prefix trie, rolled up by pointer jumping.

A turn's place is its rank in its conversation, from one range-partitioned numbering of all turns. A prefix is known by its digest: sums,
over its turns, of 32-bit pieces of SHA-256 of (place, role, text). Sums run on from block to block of a conversation, so that a long
conversation is split like any other, and a prefix less its last turn gives its parent's digest. Equal digests are one node. Subtree
totals then reach all ancestors in doubling rounds: with the totals of descendants nearer than 2^k and the ancestor 2^k above, both for
every node, adding a node's totals to that ancestor and jumping to the ancestor's ancestor gives the same for 2^(k+1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.ranges import TIE, prefix_sums
from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class TrieParams:
    """``group`` and ``heads``: in ``shared_heads``, a conversation takes its first crc32 % ``heads`` turns from the one whose id is the
    greatest multiple of ``group`` up to its own. ``block``: turns that one running sum goes over. ``piece``: ids of one piece of a digest."""

    group: int = 20
    heads: int = 4
    block: int = 4096
    piece: int = 4096


_LANES = ("s0", "s1", "s2", "s3")
#: Words of a text: runs that aren't ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, said, words), written: every turn's rank from 0 in its conversation, a digest of its role and text, its words.

    Turns go by turn (null first), then role, then the text's digest. Null role or text: empty. Repeated rows are turns of their own.
    Rows without a conversation id belong to none and are left out. Texts aren't shuffled."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.sha2(F.concat_ws(":", F.length(who).cast("string"), who, what).cast("binary"), 256)
    narrow = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().cast("int").alias("timed"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        who.alias("role"), said.alias("said"), F.regexp_count(what, F.lit(_WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias(TIE),
    ).where(F.col("conv").isNotNull())
    narrow = materialize(narrow, "trie-turns")
    order = ["conv", "timed", "turn", "role", "said", TIE]
    ranked = materialize(prefix_sums(narrow, order, "one", "one").select("conv", F.col("__idx").alias("idx"), "said", "words"), "trie-ranked")
    discard(narrow)
    first = ranked.groupBy(F.col("conv").alias("of")).agg(F.min("idx").alias("base"))
    out = materialize(ranked.join(first, F.col("conv") == F.col("of")).select("conv", (F.col("idx") - F.col("base")).alias("place"), "said", "words"), "trie-numbered")
    discard(ranked)
    return out


def shared_heads(own: DataFrame, p: TrieParams = TrieParams()) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): ``numbered`` conversations whose first turns come from another one, and (conv, length) of all of them.

    Conversation c takes the first h = crc32(decimal c) % ``heads`` turns of conversation c - c % ``group`` (all if that has fewer, none
    if there is no such conversation), then its own turns after its first h. It may end up without turns."""
    taken = lambda c: (F.crc32(c.cast("string").cast("binary")) % p.heads).cast("long")
    lengths = materialize(own.groupBy("conv").agg(F.count("*").alias("n")), "trie-lengths")
    head = F.least(F.col("h"), F.coalesce(F.col("there"), F.lit(0)))
    all_ = lengths.withColumn("h", taken(F.col("conv"))).withColumn("source", F.col("conv") - F.col("conv") % p.group)
    all_ = all_.join(lengths.select(F.col("conv").alias("source"), F.col("n").alias("there")), "source", "left").withColumn("head", head)
    plan = materialize(all_.select("conv", "h", "source", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    heads = plan.where("head > 0").select("conv", "source", "head").join(own.where(F.col("place") < p.heads).withColumnRenamed("conv", "source"), "source")
    heads = heads.where(F.col("place") < F.col("head")).select("conv", "place", "said", "words")
    rest = own.where(F.col("place") >= taken(F.col("conv"))).join(plan.select("conv", "h", "head"), "conv")
    rest = rest.select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "said", "words")
    discard(lengths)
    return heads.unionByName(rest), plan.select("conv", "length")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def _paths(turns: DataFrame, p: TrieParams) -> DataFrame:
    """(conv, depth, key, parent, words) of every turn: the node it ends at, and that node's parent."""
    lane = lambda i: F.conv(F.substring("hex", 1 + 8 * i, 8), 16, 10).cast("long")
    hashed = turns.select("conv", (F.col("place") + 1).alias("depth"), "words", F.sha2(F.concat_ws(":", F.col("place").cast("string"), "said").cast("binary"), 256).alias("hex"))
    laned = hashed.select("conv", "depth", "words", F.floor((F.col("depth") - 1) / p.block).alias("block"), *(lane(i).alias(s) for i, s in enumerate(_LANES)))
    laned = materialize(laned, "trie-lanes")
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what earlier blocks of the same conversation add: one row a block, of conversations of more than one block
    full = laned.groupBy("conv", "block").agg(*(F.sum(s).alias(s) for s in _LANES))
    long = full.join(full.where("block = 1").select("conv"), "conv", "left_semi")
    added = long.select("conv", "block", *(F.sum(s).over(before).alias(f"b{s}") for s in _LANES)).where("block > 0")
    run = laned.select("conv", "block", "depth", "words", *_LANES, *(F.sum(s).over(inside).alias(f"r{s}") for s in _LANES)).join(added, ["conv", "block"], "left")
    whole = [F.col(f"r{s}") + F.coalesce(F.col(f"b{s}"), F.lit(0)) for s in _LANES]
    parent = [w - F.col(s) for w, s in zip(whole, _LANES)]
    return materialize(run.select("conv", "depth", "words", _key(F.col("depth"), whole).alias("key"), _key(F.col("depth") - 1, parent).alias("parent")), "trie-paths")


def _ends(ends: DataFrame, p: TrieParams) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending, comma-joined ids of each key. Ids are joined to pieces in ranges of (key, id), which
    split any key; a digest then reads a piece a row, in order, and holds no more than that."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        rows: list[tuple] = []
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now or len(held) >= p.piece:
                    if held:
                        rows.append((now, held[0], ",".join(map(str, held))))
                    now, held = k, []
                held.append(c)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if held:
            rows.append((now, held[0], ",".join(map(str, held))))
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        k, first, text = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done = []
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != now:
                    if sha:
                        done.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if done:
                yield _digest_batch(done)
        if sha:
            yield _digest_batch([(now, sha.hexdigest())])

    def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
        k, text = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(text, pa.string())], ["key", "ends_sha256"])

    cut = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pieces, "key binary, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved) of every node's subtree, from (key, parent, depth, leaf, saved) of the nodes alone: doubling rounds, each
    written. A node within 2^k of the root has no ancestor 2^k above it and isn't searched for."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    held = state = materialize(nodes.select("key", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), "depth", F.col("leaf").alias("leaves"), "saved"), "trie-state")
    reach = 1
    while reach <= deepest:
        gain = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("plus"))
        jump = state.where(F.col("up").isNotNull()).select(F.col("key").alias("up"), F.col("up").alias("next"))
        deep = state.where(F.col("depth") >= 2 * reach).join(jump, "up").select("key", "next", "depth", "leaves", "saved")
        rest = state.where(F.col("depth") < 2 * reach).select("key", F.lit(None).cast("binary").alias("next"), "depth", "leaves", "saved")
        both = deep.unionByName(rest).join(gain, "key", "left")
        add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        state = materialize(both.select("key", F.col("next").alias("up"), "depth", add("leaves", "more"), add("saved", "plus")), "trie-state")
        discard(held)
        held = state
        reach *= 2
    return state.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(turns: DataFrame, lengths: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """The nodes of the trie over conversations: ``turns`` (conv, place, said, words), ``lengths`` (conv, length), as ``numbered`` and
    ``shared_heads`` give them.

    One row a distinct prefix, the empty one (the root) included: conv_id, the least member; depth; parent_conv_id, the parent's conv_id;
    n_convs, members; n_children; n_leaves, childless nodes of the subtree, its top included; saved_tokens, over the subtree, members
    beside the first times words of the last turn; ends_sha256 of the ids of members that end there. No conversations: no rows."""
    ship_package(turns.sparkSession)
    paths = _paths(turns, p)
    root = _key(F.lit(0), [F.lit(0)] * len(_LANES))
    members = paths.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    top = lengths.groupBy(root.alias("key")).agg(F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    members = materialize(members.unionByName(top), "trie-members")
    children = members.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce(F.col("n_children"), F.lit(0)).alias("n_children")
    nodes = members.join(children, "key", "left").select("key", "parent", "depth", "conv_id", "n_convs", n_children, F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = materialize(nodes, "trie-nodes")
    discard(members)
    # an end: the last turn of a conversation, or the root for one without turns
    last = paths.join(lengths.where("length > 0"), "conv").where(F.col("depth") == F.col("length")).select("key", "conv")
    ends = materialize(last.unionByName(lengths.where("length = 0").select(root.alias("key"), "conv")), "trie-ends")
    discard(paths)
    # the root is every first turn's parent, and one row
    least = nodes.where("depth = 0").select("conv_id").first()
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    deep = nodes.where("depth > 1").join(above, "parent").select(*cols)
    first = F.when(F.col("depth") == 1, F.lit(least["conv_id"] if least else None).cast("long")).alias("parent_conv_id")
    named = deep.unionByName(nodes.where("depth <= 1").select("key", "conv_id", "depth", first, "n_convs", "n_children"))
    out = named.join(_rolled(nodes), "key").join(_ends(ends, p), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*cols[1:], "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = False, p: TrieParams = TrieParams()) -> DataFrame:
    """``trie`` of a table of turns; with ``rebuilt``, of conversations with ``shared_heads``. Other columns are not read."""
    own = numbered(turns, conv, turn, role, text)
    if rebuilt:
        return trie(*shared_heads(own, p), p)
    return trie(own, materialize(own.groupBy("conv").agg(F.count("*").alias("length")), "trie-lengths"), p)


def oracle(p: TrieParams = TrieParams()) -> str:
    """The same in SQL, for small tables: prefixes as lists of turns, subtrees by comparing them (heads shared as in ``shared_heads``)."""
    step = "list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint), lambda c, b: {step}, 4294967295::bigint), 4294967295)"
    return rf"""
with own as materialized (select conv_id, {crc} % {p.heads} as h, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, role, text) as l from conversations where conv_id is not null group by conv_id),
r as materialized (select o.conv_id as c, list_concat(coalesce(a.l[1:o.h], []), o.l[o.h + 1:]) as l from own o left join own a on a.conv_id = o.conv_id - o.conv_id % {p.group}),
m as materialized (select c, d, l[1:d] as p, len(l) = d as ends from (select c, l, unnest(range(0, len(l) + 1)) as d from r)),
n as materialized (select d, p, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(p[-1].t, '[^\x20\x09-\x0D]+')) end as saved,
  sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from m group by d, p),
k as materialized (select d - 1 as d, p[1:d - 1] as p, count(*) as n_children from n where d > 0 group by all),
nk as materialized (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.d = n.d and k.p = n.p),
a as (select b.*, unnest(range(0, b.d + 1)) as up from nk b),
s as materialized (select up as d, p[1:up] as p, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from a group by all)
select nk.conv_id, nk.d as depth, q.conv_id as parent_conv_id, nk.n_convs, nk.n_children, s.n_leaves, s.saved_tokens, nk.ends_sha256
from nk join s on s.d = nk.d and s.p = nk.p left join nk q on q.d = nk.d - 1 and q.p = nk.p[1:nk.d - 1]"""
