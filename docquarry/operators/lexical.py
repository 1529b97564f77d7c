"""A stored inverted index with block maxima: BM25 searches that skip ranges of documents by their bounds.

Two tables in one folder, only ever appended to, both by segment: ``docs`` (k, dl), written last, so that a segment counts once it is
there; ``postings`` (term, range, n, max_tf, min_dl, posts), each file sorted by term: of each term and each range of at most about
``range_docs`` documents, its postings and what bounds their scores. A range is a stretch of rows of one task, so that postings are made
where the texts are read, and nothing but keys and lengths is shuffled. ``add`` indexes documents that aren't there yet, as a segment of their own; frequencies and
lengths are sums over segments. ``search`` adds up bounds by (query, range) from the small columns alone, scores each query's best ranges,
and then only those whose bound reaches the k-th score so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.operators.retrieval import BROADCAST_TERMS, STOP_WORDS, raw_terms, stem_word, top_k
from docquarry.session import discard, materialize, ship_package


@dataclass(frozen=True)
class LexicalParams:
    """``range_docs``: documents of a range, about. ``probe``: ranges that a query scores first. ``literal_terms``: up to so many terms of
    queries go to the scan as literals, so that files and row groups of other terms aren't read."""

    range_docs: int = 128
    probe: int = 4
    literal_terms: int = 10_000
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Found:
    """``rows`` (query_id, key, score, rank); ``ranges``: pairs of a query and a range that holds a term of it, and how many were scored."""

    rows: DataFrame
    ranges: int
    scored: int


#: Words whose stems a task remembers; beyond it, it starts anew.
KNOWN_STEMS = 100_000


def _stems_of(words: list[str], stems: dict[str, str]) -> list[str]:
    """The stem of each word, by way of those that ``stems`` remembers."""
    if len(stems) > KNOWN_STEMS:
        stems.clear()
    for w in words:
        if w not in stems:
            stems[w] = stem_word(w)
    return [stems[w] for w in words]


def _blocks(said: DataFrame, range_docs: int) -> DataFrame:
    """(term, range, n, max_tf, min_dl, posts) of ``said`` (k, words), a row a document: each ``range_docs`` rows of a task are a range."""
    ship_package(said.sparkSession)
    kind, k_type = said.schema["k"].dataType.simpleString(), to_arrow_type(said.schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, range_docs):
                part = b.slice(lo, range_docs)
                at += 1
                yield made(part.column(0), part.column(1), at, stems)

    def made(keys: pa.Array, words: pa.Array, at: int, stems: dict[str, str]) -> pa.RecordBatch:
        dl = np.diff(words.offsets.to_numpy()).astype(np.int64)
        said_ = words.flatten().dictionary_encode()
        known = said_.dictionary.to_pylist()
        terms, which = np.unique(np.array(_stems_of(known, stems), object), return_inverse=True) if known else (np.empty(0, object), np.empty(0, np.int64))
        pair = which[said_.indices.to_numpy()].astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl)
        pair, tf = np.unique(pair, return_counts=True)
        term, doc = np.divmod(pair, max(len(dl), 1))
        first = np.searchsorted(term, np.arange(len(terms)))
        posts = pa.StructArray.from_arrays([keys.take(pa.array(doc)).cast(k_type), pa.array(tf, pa.int64()), pa.array(dl[doc])], ["k", "tf", "dl"])
        ends = np.append(first, len(pair)).astype(np.int32)
        most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(dl[doc], first)) if len(terms) else (tf, dl[:0])
        columns = [pa.array(terms.tolist(), pa.string()), pa.array(np.full(len(terms), at)), pa.array(np.diff(ends).astype(np.int64)), pa.array(most, pa.int64()), pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), posts)]
        return pa.RecordBatch.from_arrays(columns, ["term", "range", "n", "max_tf", "min_dl", "posts"])

    return said.mapInArrow(run, f"term string, range long, n long, max_tf long, min_dl long, posts array<struct<k: {kind}, tf: long, dl: long>>")


class LexicalIndex:
    """An index of the documents of one key column in the folder ``path`` (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", p: LexicalParams = LexicalParams()):
        self.spark, self.path, self.key, self.p = spark, path.rstrip("/"), key, p

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def docs(self) -> DataFrame:
        """(k, dl, segment) of every indexed document."""
        return self.spark.read.parquet(f"{self.path}/docs")

    def postings(self) -> DataFrame:
        """The postings of all segments that were completed."""
        return self.spark.read.parquet(f"{self.path}/postings").join(F.broadcast(self.docs().select("segment").distinct()), "segment", "left_semi")

    def add(self, documents: DataFrame, text: str = "text") -> int:
        """Indexes the documents whose keys aren't there yet and returns how many; others aren't read beyond their keys, whatever their
        text. Null keys are left out. Rows of one key are one document with all their texts. Null and empty texts are documents without
        terms. Words are counted where they are read, and each distinct one of a task is stemmed once. Only the words of keys that have
        several rows are shuffled."""
        given = documents.select(F.col(self.key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull())
        new = given.join(self.docs().select("k"), "k", "left_anti") if self._exists() else given
        said = new.select("k", F.filter(raw_terms(F.col("t")), lambda w: ~w.isin(*STOP_WORDS)).alias("words"))
        sized = said.select("k", F.size("words").cast("long").alias("n"))
        docs = materialize(sized.groupBy("k").agg(F.sum("n").alias("dl"), F.count("*").alias("rows")), "lexical-docs")
        n, rows = docs.agg(F.count("*"), F.sum("rows")).first()
        if not n:
            discard(docs)
            return 0
        segment = F.lit(uuid.uuid4().hex).alias("segment")
        repeated = materialize(docs.where("rows > 1").select("k"), "lexical-repeated") if rows > n else None
        once = said if repeated is None else said.join(repeated, "k", "left_anti")
        blocks = _blocks(once, self.p.range_docs)
        if repeated is not None:
            # documents of several rows are added up first, then dealt to ranges of their own (below 0)
            each = _blocks(said.join(repeated, "k", "left_semi"), 1).select("term", F.inline("posts"))
            summed = each.groupBy("k", "term").agg(F.sum("tf").alias("tf")).join(docs.select("k", "dl"), "k")
            dealt = summed.withColumn("range", -1 - F.pmod(F.xxhash64("k"), F.lit(max(1, -(-(rows - n) // self.p.range_docs)))))
            more = dealt.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("k", "tf", "dl")).alias("posts"))
            blocks = blocks.unionByName(more)
        # sorted inside each file, so that of a file only the pages of a term are read; nothing is shuffled
        blocks.sortWithinPartitions("term", "range").select("*", segment).write.mode("append").partitionBy("segment").parquet(f"{self.path}/postings")
        docs.select("k", "dl", segment).write.mode("append").partitionBy("segment").parquet(f"{self.path}/docs")
        discard(docs, *([repeated] if repeated is not None else []))
        return n

    def _part(self, tf: Column, dl: Column, mean: float) -> Column:
        """A term's share of a score, without its weight; it grows with ``tf`` and falls with ``dl``."""
        k1, b = self.p.k1, self.p.b
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))

    def search(self, queries: DataFrame, k: int, scope: DataFrame | None = None, digits: int = 6) -> Found:
        """The ``k`` best documents of each query (query_id, term; distinct) by rounded score, then key. Exact. ``scope``, distinct keys,
        limits what is returned, not the statistics."""
        if k <= 0:
            raise ValueError("k must be positive")
        n, mean = self.docs().agg(F.count("*"), F.avg("dl")).first()
        mean = float(mean or 1)
        asked = queries.select("term").distinct()
        few = [r[0] for r in asked.limit(self.p.literal_terms + 1).collect()]
        literal = len(few) <= self.p.literal_terms
        mine = self.postings().where(F.col("term").isin(few)) if literal else self.postings().join(asked, "term", "left_semi")
        counted = mine.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = materialize(queries.join(counted, "term").select("query_id", "term", idf.alias("idf")), "lexical-queries")
        small = weighted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        weights = F.broadcast(weighted) if small else weighted
        bounds = mine.select("segment", "term", "range", "max_tf", "min_dl").join(weights, "term")
        bounds = materialize(bounds.groupBy("query_id", "segment", "range").agg(F.sum(F.col("idf") * self._part(F.col("max_tf"), F.col("min_dl"), mean)).alias("bound")), "lexical-bounds")
        best = top_k(bounds, max(self.p.probe, -(-2 * k // self.p.range_docs)), "query_id", F.col("bound").desc(), F.col("segment"), F.col("range"))
        first = materialize(best.select("query_id", "segment", "range"), "lexical-first")
        near = materialize(self._scored(mine, weights, first, mean, scope, digits), "lexical-near")
        kth = top_k(near, k, "query_id", F.col("score").desc(), F.col("k")).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        rest = bounds.join(first, ["query_id", "segment", "range"], "left_anti").join(kth.select("query_id", "least"), "query_id", "left")
        rest = materialize(rest.where(F.col("least").isNull() | (F.col("bound") + 10.0**-digits >= F.col("least"))).select("query_id", "segment", "range"), "lexical-second")
        every = near.unionByName(self._scored(mine, weights, rest, mean, scope, digits))
        rows = top_k(every, k, "query_id", F.col("score").desc(), F.col("k")).withColumnRenamed("k", self.key)
        return Found(rows, bounds.count(), first.count() + rest.count())

    def _scored(self, mine: DataFrame, weights: DataFrame, pairs: DataFrame, mean: float, scope: DataFrame | None, digits: int) -> DataFrame:
        """(query_id, k, score) of the documents in ``pairs`` (query_id, segment, range) that hold a term of the query."""
        small = pairs.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        ranges = pairs.select("segment", "range").distinct()
        read = mine.join(F.broadcast(ranges) if small else ranges, ["segment", "range"], "left_semi").select("segment", "range", "term", "posts")
        met = read.join(weights, "term").join(F.broadcast(pairs) if small else pairs, ["query_id", "segment", "range"], "left_semi")
        posts = met.select("query_id", "idf", F.explode("posts").alias("p")).select("query_id", "idf", "p.*")
        if scope is not None:
            posts = posts.join(scope.select(F.col(self.key).alias("k")), "k", "left_semi")
        return posts.groupBy("query_id", "k").agg(F.round(F.sum(F.col("idf") * self._part(F.col("tf"), F.col("dl"), mean)), digits).alias("score"))


def index_of(documents: DataFrame, folder: str, key: str = "doc_id", text: str = "text", p: LexicalParams = LexicalParams()) -> LexicalIndex:
    """The index of exactly these documents in ``folder``, named by a digest of their keys and texts: built once, then read."""
    n, digest = documents.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(key, text).cast("decimal(38,0)")), F.lit(0))).first()
    index = LexicalIndex(documents.sparkSession, f"{folder}/lexical-{n}-{abs(int(digest)):x}", key, p)
    if not index._exists():
        index.add(documents, text)
    return index
