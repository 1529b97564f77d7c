"""Terms, dense retrieval by products, rank fusion and reranking over query sets (`lexical` and `knn` have the indexes)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import ship_package

#: English stop words of lexical indexes.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Up to so many rows of query terms, or query vectors, are broadcast; beyond it, they are joined by shuffle.
BROADCAST_TERMS, BROADCAST_VECTORS = 1_000_000, 20_000
BLOCK = 1024


def stems(words: Column) -> Column:
    """Light English stems of an array of words: plurals, then -ed and -ing after a vowel with the letter that they changed, then a final
    y. Each step is an array of its own, so that no pattern is tried twice."""
    plain = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "sses$", "ss"), "([a-z]{2})ies$", "$1i"), "([a-rtv-z])s$", "$1"))
    both = F.transform(plain, lambda w: F.struct(w.alias("w"), F.regexp_replace(w, "([aeiouy][a-z]*)(ed|ing)$", "$1").alias("cut")))

    def mended(c: Column) -> Column:
        return F.when(c.rlike("(at|bl|iz)$"), F.concat(c, F.lit("e"))).when(c.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)

    bare = F.transform(both, lambda x: F.when((x["cut"] != x["w"]) & ~F.endswith(x["w"], F.lit("eed")), mended(x["cut"])).otherwise(x["w"]))
    return F.transform(bare, lambda w: F.regexp_replace(w, "([a-z][b-df-hj-np-tv-xz])y$", "$1i"))


def stem(word: Column) -> Column:
    """The stem of one word."""
    return F.get(stems(F.array(word)), F.lit(0))


_CUTS = [(re.compile(a), b) for a, b in (("sses\\Z", "ss"), ("([a-z]{2})ies\\Z", r"\1i"), ("([a-rtv-z])s\\Z", r"\1"))]
_PAST, _MUTE, _TWICE, _Y = (re.compile(x) for x in ("([aeiouy][a-z]*)(?:ed|ing)\\Z", "(?:at|bl|iz)\\Z", "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)\\Z", "([a-z][b-df-hj-np-tv-xz])y\\Z"))


def stem_word(word: str) -> str:
    """``stem`` of one word, where the words are in Python already."""
    for pattern, left in _CUTS:
        word = pattern.sub(left, word)
    cut = _PAST.sub(r"\1", word)
    if cut != word and not word.endswith("eed"):
        word = cut + "e" if _MUTE.search(cut) else cut[:-1] if _TWICE.search(cut) else cut
    return _Y.sub(r"\1i", word)


def raw_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def terms(text: Column) -> Column:
    """Indexed terms: stems of what isn't a stop word."""
    return stems(F.filter(raw_terms(text), lambda w: ~w.isin(*STOP_WORDS)))


def top_k(scored: DataFrame, k: int, group: str, *order: Column) -> DataFrame:
    """The first ``k`` of each group, with ``rank`` from 1; the order should end in an id, so that ties are fixed."""
    if k <= 0:
        raise ValueError("k must be positive")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _products(queries: DataFrame, rows: DataFrame, query: str, query_vector: str, key: str, vector: str, reduce, schema: str) -> DataFrame:
    """``reduce(query ids, query matrix, row ids, row matrix)`` -> columns of ``schema``, for every block of queries against every block of
    rows, as matrix products. Rows stay where they are if the counted queries are few; otherwise blocks meet by shuffle on the block of
    queries. Rows without a vector are left out; vectors of one length are assumed, others raise."""
    ship_package(rows.sparkSession)
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    n = q.count()
    blocks = -(-n // BLOCK) or 1
    sides = q.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("q", "v")).alias("x"))
    sides = sides.select("block", F.transform("x", lambda x: x["q"]).alias("qs"), F.flatten(F.transform("x", lambda x: x["v"])).alias("qm"))
    kind = rows.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                flat, m = part.column(1).flatten(), part.num_rows
                ids = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], ["rs", "rm"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qs, rs = b.column(0)[i].values, b.column(2)[i].values
                qm, rm = (b.column(k)[i].values.to_numpy(zero_copy_only=False).reshape(len(x), -1) for k, x in ((1, qs), (3, rs)))
                yield reduce(np.asarray(qs.to_pylist()), qm, np.asarray(rs.to_pylist()), rm)

    packed_rows = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>")).mapInArrow(packed, f"rs array<{kind}>, rm array<double>")
    each = packed_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.join(F.broadcast(sides) if n <= BROADCAST_VECTORS else sides, "block").select("qs", "qm", "rs", "rm").mapInArrow(meet, schema)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, key, distance, rank): the ``k`` nearest rows of each query by squared distance (rounded, so that equal ones tie), then
    key; no index, so exact. ``queries``: (query_id, vector). Each block gives up all but its own ``k`` best before the shuffle."""
    q_kind, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()

    def reduce(qs: np.ndarray, qm: np.ndarray, rs: np.ndarray, rm: np.ndarray) -> pa.RecordBatch:
        d = np.round(np.maximum((qm * qm).sum(1)[:, None] + (rm * rm).sum(1) - 2 * qm @ rm.T, 0), digits)
        edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        i, j = np.nonzero(d <= edge[:, None])
        order = np.lexsort((rs[j], d[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pa.RecordBatch.from_arrays([pa.array(qs[i]), pa.array(rs[j]), pa.array(d[i, j])], ["query_id", "k", "distance"])

    if k <= 0:
        raise ValueError("k must be positive")
    near = _products(queries, vectors, "query_id", vector, key, vector, reduce, f"query_id {q_kind}, k {kind}, distance double").withColumnRenamed("k", key)
    return top_k(near, k, "query_id", F.col("distance").asc(), F.col(key).asc())


def collapse_to_parents(ranked: DataFrame, child_parent: DataFrame, group: str = "query_id", child: str = "doc_id") -> DataFrame:
    """Children's ranks to their parents' (best child first), re-ranked densely; children without a parent are dropped."""
    best = ranked.join(child_parent, child).groupBy(group, "parent_id").agg(F.min("rank").alias("best"))
    return best.select(group, "parent_id", F.row_number().over(Window.partitionBy(group).orderBy("best")).cast("long").alias("rank"))


def rrf(lexical: DataFrame | None, dense: DataFrame | None, key: str, group: str = "query_id", w_lexical: float = 1.0, w_dense: float = 1.0, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion: both ranks and the sum of weight / (k + rank). A side of weight 0 is left out, not even read; it may
    be None, so that nobody has to search it."""
    if k <= 0 or w_lexical < 0 or w_dense < 0 or w_lexical + w_dense == 0:
        raise ValueError("k must be positive, weights not negative and not both 0")
    if (w_lexical and lexical is None) or (w_dense and dense is None):
        raise ValueError("a side with a weight is missing")

    def side(ranked: DataFrame | None, other: DataFrame | None, weight: float, rank: str) -> DataFrame:
        got = ranked if ranked is not None else other
        return got.where(F.lit(weight > 0)).select(group, key, F.col("rank").alias(rank))

    a, b = side(lexical, dense, w_lexical, "lexical_rank"), side(dense, lexical, w_dense, "dense_rank")
    score = F.coalesce(F.lit(w_lexical) / (k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(F.lit(w_dense) / (k + F.col("dense_rank")), F.lit(0.0))
    return a.join(b, [group, key], "full_outer").withColumn("rrf_score", score)


def hybrid(lexical: DataFrame | None, dense: DataFrame | None, key: str, k: int = 5, group: str = "query_id", **weights: float) -> DataFrame:
    """The ``k`` best of each query after fusion, by score, then id."""
    return top_k(rrf(lexical, dense, key, group, **weights), k, group, F.col("rrf_score").desc(), F.col(key).asc())


def rerank(hits: DataFrame, k: int, key: str, group: str = "query_id") -> DataFrame:
    """By the scorer's score, then the prior score, then id; ``prev_rank`` is kept."""
    return top_k(hits.withColumnRenamed("rank", "prev_rank"), k, group, F.col("scorer_score").desc(), F.col("rrf_score").desc(), F.col(key).asc())


def best_entities(mentions: DataFrame, aliases: DataFrame, k: int = 3, digits: int = 6) -> DataFrame:
    """(mention_id, ticker, score, rank): each mention's ``k`` best tickers by the cosine (rounded) of their best alias, clamped to [-1, 1],
    then name. Vectors have unit length.

    ``mentions``: (mention_id, mention_vector); ``aliases``: (ticker, alias_vector), in blocks against blocks of mentions. A block gives up
    its own ``k`` best tickers a mention: one among the best of all is among the best of the block that holds its best alias."""
    if k <= 0:
        raise ValueError("k must be positive")
    kind = mentions.schema["mention_id"].dataType.simpleString()

    def reduce(qs: np.ndarray, qm: np.ndarray, rs: np.ndarray, rm: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(rs, kind="stable")
        names, first = np.unique(rs[order], return_index=True)
        best = np.round(np.maximum.reduceat(np.clip(qm @ rm[order].T, -1, 1), first, axis=1), digits)
        top = np.argsort(-best, axis=1, kind="stable")[:, :k]  # names ascend, so equal scores go by name
        score = np.take_along_axis(best, top, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, top.shape[1])), pa.array(names[top.ravel()].tolist(), pa.string()), pa.array(score.ravel())], ["mention_id", "ticker", "score"])

    got = _products(mentions, aliases, "mention_id", "mention_vector", "ticker", "alias_vector", reduce, f"mention_id {kind}, ticker string, score double")
    return top_k(got.groupBy("mention_id", "ticker").agg(F.max("score").alias("score")), k, "mention_id", F.col("score").desc(), F.col("ticker").asc())


#: Answers that stand for none.
NULL_LIKE = ("NULL", "NONE", "N/A", "NA", "UNKNOWN", "")


def normalize_picks(picks: DataFrame, slate: DataFrame) -> DataFrame:
    """Adds ticker and outcome: resolved if the pick is on the slate (ticker, listed), unknown if null-like, else off_list."""
    clean = F.upper(F.trim("pick"))
    small = slate.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    got = picks.withColumn("__p", clean).join(F.broadcast(slate) if small else slate, F.col("__p") == F.col("ticker"), "left")
    none = F.col("pick").isNull() | F.col("__p").isin(*NULL_LIKE)
    return got.withColumn("outcome", F.when(none, "unknown").when(F.col("listed"), "resolved").otherwise("off_list")).drop("__p", "listed")


def set_f1(gold: DataFrame, got: DataFrame, group: str, item: str) -> DataFrame:
    """(group, gold, got, tp, f1) of distinct items; empty on both sides is 1, no hit is 0."""
    g, o = gold.withColumn("__g", F.lit(1)), got.withColumn("__o", F.lit(1))
    n = g.join(o, [group, item], "full_outer").groupBy(group).agg(F.count("__g").alias("gold"), F.count("__o").alias("got"), F.count_if(F.col("__g").isNotNull() & F.col("__o").isNotNull()).alias("tp"))
    return n.withColumn("f1", F.when((F.col("gold") == 0) & (F.col("got") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("gold") + F.col("got"))))
