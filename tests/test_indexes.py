"""Indexes for retrieval, as-of reads by ranges, and what read-only SQL refuses."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import knn, lexical, pit, readers, retrieval


def ranks(df):
    return {tuple(r) for r in df.select("query_id", "vec_id", "distance", "rank").collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty clusters, one of which holds half of the rows, a group of equal vectors, null and odd ones."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 8)) * 4
    x = np.concatenate([c + rng.normal(size=(900 if i == 3 else 40, 8)) * 0.3 for i, c in enumerate(centre)] + [np.repeat(centre[5:6], 120, 0)])
    rows = [(int(i), [float(a) for a in v], int(i) % 3) for i, v in enumerate(x)] + [(9001, None, 1), (9002, [1.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, k int").repartition(5)


@pytest.mark.parametrize("k", [1, 7, 150])
def test_index_search_is_exact_and_skips(spark, clustered, k):
    q = clustered.where("vec_id % 20 = 0 and vec_id < 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    index = knn.build(clustered, p=knn.KnnParams(block=32, pack=16))
    assert index.blocks.agg(F.max("n"), F.sum("n")).first() == (32, clustered.count() - 2)
    got = knn.search(index, q, k)
    assert ranks(got.rows) == ranks(retrieval.dense_topk(q, clustered.where("size(embedding) = 8"), k))
    assert got.read < (got.pairs / 2 if k == 1 else got.pairs if k == 7 else 2 * got.pairs)  # a pair may be read in both passes
    index.discard()


def test_index_search_edges(spark, clustered):
    q = clustered.where("vec_id in (0, 1, 9001, 9002)").select(F.col("vec_id").alias("query_id"), "embedding")
    few = clustered.where("vec_id < 3")
    assert ranks(knn.nearest(q, few, 10)) == ranks(retrieval.dense_topk(q.where("query_id < 9"), few, 10))
    assert knn.nearest(q, few.where("vec_id < 0"), 3).count() == 0 and knn.nearest(q.where("query_id < 0"), few, 3).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(q, few, 0)


def test_best_entities_of_blocks_are_the_best_of_all(spark):
    rng = random.Random(2)
    unit = lambda: [x / math.sqrt(sum(y * y for y in v)) for v in [[rng.gauss(0, 1) for _ in range(4)]] for x in v]
    aliases = [(f"T{k % 9}", unit()) for k in range(60)] + [("T1", None)]
    mentions = [(k, unit()) for k in range(20)]
    got = retrieval.best_entities(spark.createDataFrame(mentions, "mention_id long, mention_vector array<double>"), spark.createDataFrame(aliases, "ticker string, alias_vector array<double>").repartition(7), 3)
    want = set()
    for m, v in mentions:
        best = {}
        for t, a in aliases:
            if a:
                best[t] = max(best.get(t, -1), round(max(-1, min(1, sum(x * y for x, y in zip(v, a)))), 6))
        want |= {(m, t, s, r) for r, (s, t) in enumerate(sorted(((s, t) for t, s in best.items()), key=lambda x: (-x[0], x[1]))[:3], 1)}
    assert {tuple(r) for r in got.select("mention_id", "ticker", "score", "rank").collect()} == want


# --- the stored index ---------------------------------------------------------------------------------------------------------------
def plain_bm25(docs, queries, k, scope=None, k1=1.2, b=0.75):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = set()
    for q, terms in queries.items():
        scores = {}
        for t in terms:
            df = sum(t in d for d in docs.values())
            for key, d in docs.items():
                tf = d.count(t)
                if tf and (scope is None or key in scope):
                    scores[key] = scores.get(key, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
        out |= {(q, key, r) for r, (s, key) in enumerate(sorted(((-round(s, 6), key) for key, s in scores.items()))[:k], 1)}
    return out


def found(f):
    return {(r["query_id"], r["doc_id"], r["rank"]) for r in f.rows.collect()}


def test_stored_index(spark, tmp_path):
    rng = random.Random(4)
    words = [f"term{k}x" for k in range(60)]
    docs = {k: [rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.randint(1, 40))] for k in range(400)} | {400: [], 401: []}
    rows = [(k, " ".join(d).upper() + " the and of" if k < 400 else (None if k == 400 else "")) for k, d in docs.items()] + [(None, "term1x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    queries = {1: {"term0x", "term55x"}, 2: {"term30x"}, 3: {"term1x", "term2x", "term3x", "absent"}}
    q = spark.createDataFrame([(k, t) for k, v in queries.items() for t in v], "query_id long, term string")
    index = lexical.LexicalIndex(spark, str(tmp_path / "index"), p=lexical.LexicalParams(range_docs=8, probe=2))
    first = {k: d for k, d in docs.items() if k < 250}
    assert index.add(df.where("doc_id < 250")) == 250
    assert found(index.search(q, 5)) == plain_bm25(first, queries, 5)
    segment = {r[0] for r in index.docs().select("segment").distinct().collect()}
    assert index.add(df) == 152 and index.add(df) == 0  # the second batch indexes only itself
    assert index.docs().where(F.col("segment").isin(*segment)).count() == 250 and index.docs().select("segment").distinct().count() == 2
    got = index.search(q, 5)
    assert found(got) == plain_bm25(docs, queries, 5) and got.scored < got.ranges
    scope = set(range(0, 400, 7))
    assert found(index.search(q, 5, spark.createDataFrame([(k,) for k in scope], "doc_id long"))) == plain_bm25(docs, queries, 5, scope)
    assert found(index.search(q, 1000)) == plain_bm25(docs, queries, 1000)
    assert index.search(q.where("query_id < 0"), 5).rows.count() == 0
    # terms of queries reach the scan; other terms' files and row groups aren't read
    plan = index.postings().where(F.col("term").isin("term1x"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term,term1x)]" in plan or "In(term" in plan or "term1x" in plan.split("PushedFilters")[1][:80]


def test_unfinished_segments_do_not_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    index = lexical.LexicalIndex(spark, str(tmp_path / "index"))
    index.add(df)
    index.spark.read.parquet(f"{index.path}/postings").drop("segment").withColumn("segment", F.lit("lost")).write.mode("append").partitionBy("segment").parquet(f"{index.path}/postings")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, term string")
    assert found(index.search(q, 5)) == {(1, 2, 1), (1, 1, 2)} and index.postings().where("term = 'alpha'").agg(F.sum("n")).first()[0] == 2


def test_one_index_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    a, b = (lexical.index_of(df, str(tmp_path)) for _ in range(2))
    assert a.path == b.path and a.docs().select("segment").distinct().count() == 1
    assert lexical.index_of(df.where("doc_id = 1"), str(tmp_path)).path != a.path


# --- as of --------------------------------------------------------------------------------------------------------------------------
def test_as_of_by_ranges_of_one_hot_entity(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    when = lambda: start + dt.timedelta(minutes=rng.randint(0, 3000))
    who = lambda: rng.choice([1] * 30 + [2, 3, None])
    feats = [(who(), when(), k, rng.choice([None, k])) for k in range(1500)]
    spine = [(k, who(), rng.choice([when(), when(), None])) for k in range(1500)]
    f = spark.createDataFrame(feats, "e long, as_of_ts timestamp, n long, v long")
    s = spark.createDataFrame(spine, "id long, e long, t timestamp")
    for ttl in (0, 1):
        want = {}
        for k, e, t in spine:
            seen = [x for x in feats if t and x[0] == e and x[1] <= t]
            last = max(seen, key=lambda x: (x[1], x[2]), default=None)
            want[k] = last[2] if last and (not ttl or last[1] >= t - dt.timedelta(days=ttl)) else None
        for per in (20, 400, 1_000_000):
            assert {r["id"]: r["n"] for r in pit.as_of(s, f, "e", "t", ["n", "v"], ttl, tie="n", rows_per_range=per).collect()} == want
    # no stretch of one entity above its share
    cuts = pit._cuts(f.select(F.unix_micros("as_of_ts").alias("micros")).unionByName(s.select(F.unix_micros("t").alias("micros"))), 20)
    rows = f.select("e", F.unix_micros("as_of_ts").alias("m")).unionByName(s.select("e", F.unix_micros("t").alias("m"))).where("m is not null")
    place = sum(((F.col("m") >= c).cast("int") for c in cuts), F.lit(0))
    assert rows.groupBy("e", place.alias("r")).count().agg(F.max("count")).first()[0] <= 3 * rows.count() / 64
    assert pit.as_of(s.where("id < 0"), f, "e", "t", ["n"], tie="n").count() == 0 and pit.as_of(s, f.where("n < 0"), "e", "t", ["n"], tie="n").where("n is not null").count() == 0


# --- read-only SQL ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def allowed(spark):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("own_function", lambda x: x)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string")
    yield {"customer": t, "orders": t}
    spark.catalog.dropTempView("hidden")


@pytest.mark.parametrize(
    "sql",
    [
        "select * from customer, hidden", "select * from customer c, parquet.`/tmp/x`", "select * from (hidden)", "select * from customer where id in (table hidden)",
        "select * from customer union all table hidden", "select own_function(id) from customer", "select reflect('java.lang.System', 'exit', 1) from customer",
        "select 1; select 2", "show tables", "explain select 1", "select * from customer, (with hidden as (select 1) select * from hidden) z, hidden",
        "select (select max(id) from hidden) from customer", "select * from identifier('hidden')", "from hidden select *", "select * from customer order by (select max(id) from hidden)",
        "select transform(id) using 'cat' from customer", "select * from default.customer", "set spark.x = 1", "create view v as select 1", "begin select 1; end",
        "select * from customer |> union all (table hidden)", "with a as (select * from hidden) select * from a", "cache table customer", "select * from read_files('/tmp')",
    ],
)
def test_what_read_only_sql_refuses(spark, allowed, sql):
    with pytest.raises(PermissionError):
        readers.read_only_sql(spark, sql, allowed)


@pytest.mark.parametrize(
    "sql,n",
    [
        ("select a.id, count(*) n from customer a, orders b where a.id = b.id group by a.id having count(*) > 0 order by 1", 2),
        ("with x as (select id from customer), y as (select * from x) select * from y join orders using (id)", 2),
        ("select * from customer where id in (select id from orders) and exists (select 1 from orders o where o.id = customer.id)", 2),
        ("with recursive r as (select 1 as v union all select v + 1 from r where v < 3) select * from r", 3),
        ("select '{x} from hidden' as s, n from customer -- hidden", 2),
        ("select id, row_number() over (partition by n order by id) r, transform(array(id), x -> x + 1) from customer union all select 1, 2, array(3)", 3),
        ("select e from customer lateral view explode(array(1, 2)) z as e", 4),
    ],
)
def test_what_read_only_sql_runs(spark, allowed, sql, n):
    assert readers.read_only_sql(spark, sql, allowed).count() == n
