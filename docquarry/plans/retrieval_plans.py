"""Lexical, dense and hybrid retrieval, fusion, reranking, entity candidates and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import numbers
from docquarry.operators import knn, lexical
from docquarry.operators import retrieval as op
from docquarry.plans.common import sql_values, table, values
from docquarry.plans.registry import register
from docquarry.session import shared_dir

S = SparkSession
K1, B = 1.2, 0.75

def _stem_sql(w: str) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace({w}, 'sses$', 'ss'), '([a-z]{{2}})ies$', '\\1i'), '([a-rtv-z])s$', '\\1')"
    cut = f"regexp_replace({plain}, '([aeiouy][a-z]*)(ed|ing)$', '\\1')"
    mended = f"case when regexp_matches({cut}, '(at|bl|iz)$') then {cut} || 'e' when regexp_matches({cut}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then left({cut}, length({cut}) - 1) else {cut} end"
    return f"regexp_replace(case when regexp_matches({plain}, '[aeiouy][a-z]*(ed|ing)$') and not regexp_matches({plain}, 'eed$') then {mended} else {plain} end, '([a-z][b-df-hj-np-tv-xz])y$', '\\1i')"


_STOPS = ", ".join(f"'{w}'" for w in op.STOP_WORDS)
_TERMS_SQL = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' and x not in ({_STOPS}))"
_POST_SQL = f"(select doc_id, {_stem_sql('w')} as term, count(*) as tf, any_value(dl)::bigint as dl from (select doc_id, unnest(t) as w, len(t) as dl from (select doc_id, {_TERMS_SQL} as t from documents)) group by doc_id, term)"
_BM25_SQL = f"""post as {_POST_SQL}, q as (select distinct query_id, {_stem_sql('w')} as term from (select item_id as query_id, unnest({_TERMS_SQL}) as w from benchmark where item_id % 20 = 0)),
 df as (select term, count(*) as df from post group by term), st as (select (select count(*) from documents) as n, (select avg(len({_TERMS_SQL})) from documents) as mean),
 lex as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), 6) as score from post join q using (term) join df using (term), st group by query_id, doc_id),
 lexk as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from lex qualify rank <= 20)"""
_DIST_SQL = "round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6)"
_DENSE_SQL = f"""dist as (select q.vec_id as query_id, v.vec_id as doc_id, {_DIST_SQL} as distance from embeddings v, (select * from embeddings where vec_id % 20 = 0) q),
 densek as (select query_id, doc_id, distance, row_number() over (partition by query_id order by distance, doc_id) as rank from dist qualify rank <= 20)"""
_FUSE_SQL = """fused as (select query_id, doc_id, l.rank as lexical_rank, d.rank as dense_rank, coalesce(1.0::double / (60 + l.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0) as rrf_score from lexk l full join densek d using (query_id, doc_id))"""


def _index(spark: S, d: str) -> lexical.LexicalIndex:
    return lexical.index_of(table(spark, d, "documents"), shared_dir(spark), p=lexical.LexicalParams(k1=K1, b=B))


def _lexical(spark: S, d: str, scope: DataFrame | None = None) -> DataFrame:
    """Twenty best documents for each benchmark item whose id is divisible by 20, by BM25."""
    q = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.explode(op.terms(F.col("text"))).alias("term")).distinct()
    return _index(spark, d).search(q, 20, scope).rows


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _dense(spark: S, d: str) -> DataFrame:
    """Twenty nearest vectors of each vector whose id is divisible by 20, by exact distance."""
    v = table(spark, d, "embeddings")
    return op.dense_topk(_queries(v), v, 20).withColumnRenamed("vec_id", "doc_id")


@register("bm25_postings", f"select term, count(*) as df, sum(tf)::bigint as cf, max(dl)::bigint as longest from {_POST_SQL} group by term")
def bm25_postings(spark: S, d: str) -> DataFrame:
    posts = _index(spark, d).postings().select("term", F.explode("posts").alias("p"))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("p.tf").alias("cf"), F.max("p.dl").alias("longest"))


@register("bm25_topk", f"with {_BM25_SQL} select query_id, doc_id, rank, round(score, 4) as score from lexk")
def bm25_topk(spark: S, d: str) -> DataFrame:
    return _lexical(spark, d).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@register("dense_topk", f"with {_DENSE_SQL} select query_id, doc_id, rank, distance from densek")
def dense_topk(spark: S, d: str) -> DataFrame:
    """The same through an index that skips blocks of rows."""
    v = table(spark, d, "embeddings")
    return knn.nearest(_queries(v), v, 20).select("query_id", F.col("vec_id").alias("doc_id"), "rank", "distance")


@register("bm25_scoped", f"with {_BM25_SQL.replace('from lex qualify', 'from lex where doc_id % 4 = 1 qualify')} select query_id, doc_id, rank, round(score, 4) as score from lexk")
def bm25_scoped(spark: S, d: str) -> DataFrame:
    """The search inside a scope of documents: statistics are those of all of them."""
    scope = table(spark, d, "documents").where("doc_id % 4 = 1").select("doc_id")
    return _lexical(spark, d, scope).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@register("dense_topk_filtered", f"select query_id, vec_id, rank from (select q.vec_id as query_id, v.vec_id, row_number() over (partition by q.vec_id order by {_DIST_SQL}, v.vec_id) as rank from embeddings v, (select * from embeddings where vec_id % 20 = 0) q where v.label = 1) where rank <= 10")
def dense_topk_filtered(spark: S, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return knn.nearest(_queries(v), v.where("label = 1"), 10).select("query_id", "vec_id", "rank")


@register("parent_collapse", f"with {_DENSE_SQL} select query_id, parent_id, row_number() over (partition by query_id order by best) as rank from (select query_id, doc_id // 4 as parent_id, min(rank) as best from densek where doc_id % 4 <> 3 group by all)")
def parent_collapse(spark: S, d: str) -> DataFrame:
    parents = table(spark, d, "embeddings").where("vec_id % 4 <> 3").select(F.col("vec_id").alias("doc_id"), F.expr("vec_id div 4").alias("parent_id"))
    return op.collapse_to_parents(_dense(spark, d), parents)


@register("rrf_fuse", f"with {_BM25_SQL}, {_DENSE_SQL}, {_FUSE_SQL} select query_id, doc_id, lexical_rank, dense_rank, round(rrf_score, 10) as rrf_score from fused")
def rrf_fuse(spark: S, d: str) -> DataFrame:
    return op.rrf(_lexical(spark, d), _dense(spark, d), "doc_id").withColumn("rrf_score", F.round("rrf_score", 10))


@register("hybrid_retrieve", f"with {_BM25_SQL}, {_DENSE_SQL}, {_FUSE_SQL} select query_id, doc_id, rank, round(rrf_score, 10) as rrf_score from (select *, row_number() over (partition by query_id order by rrf_score desc, doc_id) as rank from fused) where rank <= 5")
def hybrid_retrieve(spark: S, d: str) -> DataFrame:
    got = op.hybrid(_lexical(spark, d), _dense(spark, d), "doc_id", 5)
    return got.select("query_id", "doc_id", "rank", F.round("rrf_score", 10).alias("rrf_score"))


@register("hybrid_one_sided", f"with {_DENSE_SQL} select query_id, doc_id, rank, round(0.5 / (60 + rank), 10) as rrf_score from densek where rank <= 5")
def hybrid_one_sided(spark: S, d: str) -> DataFrame:
    """Fusion with a weight of 0 on the lexical side: that side isn't searched."""
    got = op.hybrid(None, _dense(spark, d), "doc_id", 5, w_lexical=0.0, w_dense=0.5)
    return got.select("query_id", "doc_id", "rank", F.round("rrf_score", 10).alias("rrf_score"))


@register("rerank_topk", f"with {_DENSE_SQL} select query_id, doc_id, prev_rank, rank from (select query_id, doc_id, rank as prev_rank, row_number() over (partition by query_id order by doc_id % 3 desc, 1.0 / (60 + rank) desc, doc_id) as rank from densek) where rank <= 5")
def rerank_topk(spark: S, d: str) -> DataFrame:
    hits = _dense(spark, d).withColumn("scorer_score", (F.col("doc_id") % 3).cast("double")).withColumn("rrf_score", 1 / (60 + F.col("rank")))
    return op.rerank(hits, 5, "doc_id").select("query_id", "doc_id", "prev_rank", "rank")


@register("softmax_pair", "select event_id, round(1 / (1 + exp((user_id % 7)::double - value / 50)), 8) as p from events")
def softmax_pair(spark: S, d: str) -> DataFrame:
    p = numbers.softmax_yes(F.col("value") / 50, (F.col("user_id") % 7).cast("double"))
    return table(spark, d, "events").select("event_id", F.round(p, 8).alias("p"))


@register("entity_topk", "with p as (select m.vec_id as mention_id, 'T' || (a.vec_id % 20) as ticker, round(max(greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(m.embedding, a.embedding), lambda z: z[1]::double * z[2]::double))))), 6) as score from (select * from embeddings where vec_id % 20 = 0) m, embeddings a group by all) select mention_id, ticker, score, rank from (select *, row_number() over (partition by mention_id order by score desc, ticker) as rank from p) where rank <= 3")
def entity_topk(spark: S, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    aliases = v.select(F.concat(F.lit("T"), F.col("vec_id") % 20).alias("ticker"), F.col("embedding").alias("alias_vector"))
    mentions = _queries(v).withColumnsRenamed({"query_id": "mention_id", "embedding": "mention_vector"})
    return op.best_entities(mentions, aliases, 3).select("mention_id", "ticker", "score", "rank")


@register("vector_norm_check", "select label, count(*) as n, count(*) filter (where abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) <= 0.001) as unit from embeddings group by label")
def vector_norm_check(spark: S, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(numbers.is_unit(F.col("embedding"))).alias("unit"))


@register("precision_at_k", f"with {_DENSE_SQL} select k.query_id, count(*) filter (where v.label = q.label) / 10.0::double as p from densek k join embeddings v on v.vec_id = doc_id join embeddings q on q.vec_id = query_id where rank <= 10 group by k.query_id")
def precision_at_k(spark: S, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _dense(spark, d).where("rank <= 10").select("query_id", "doc_id").join(lab.withColumnsRenamed({"vec_id": "doc_id"}), "doc_id")
    hits = hits.join(lab.withColumnsRenamed({"vec_id": "query_id", "label": "gold"}), "query_id")
    return hits.groupBy("query_id").agg((F.count_if(F.col("label") == F.col("gold")) / 10.0).alias("p"))


@register("accuracy_nullsafe", "select count(*) as n, avg((q is not distinct from p)::int) as accuracy from (select nullif(quality, 0) as q, case when doc_id % 9 = 0 then null else 1 end as p from labels)")
def accuracy_nullsafe(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.nullif("quality", F.lit(0)).alias("q"), F.when(F.col("doc_id") % 9 != 0, 1).alias("p"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("q").eqNullSafe(F.col("p")).cast("int")).alias("accuracy"))


_GOLD = "(select l_orderkey as doc, l_partkey as q from lineitem where l_linenumber <= 4 group by all)"
_GOT = "(select l_orderkey as doc, l_partkey as q from lineitem where l_linenumber between 2 and 5 group by all)"


@register("f1_gold", f"select doc, gold, got, tp, round(case when gold = 0 and got = 0 then 1 when tp = 0 then 0 else 2.0::double * tp / (gold + got) end, 9) as f1 from (select doc, count(gq) as gold, count(oq) as got, count(*) filter (where gq is not null and oq is not null) as tp from (select coalesce(g.doc, o.doc) as doc, g.q as gq, o.q as oq from {_GOLD} g full join {_GOT} o on g.doc = o.doc and g.q = o.q) group by doc)")
def f1_gold(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("q"), "l_linenumber")
    gold = li.where("l_linenumber <= 4").select("doc", "q").distinct()
    return op.set_f1(gold, li.where("l_linenumber between 2 and 5").select("doc", "q").distinct(), "doc", "q").withColumn("f1", F.round("f1", 9))


@register("quote_set_ops", f"select 'tp' as kind, count(*) as n from (select * from {_GOLD} intersect select * from {_GOT}) union all select 'fn', count(*) from (select * from {_GOLD} except select * from {_GOT}) union all select 'fp', count(*) from (select * from {_GOT} except select * from {_GOLD})")
def quote_set_ops(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("q"), "l_linenumber")
    gold, got = li.where("l_linenumber <= 4").select("doc", "q"), li.where("l_linenumber between 2 and 5").select("doc", "q")
    kinds = {"tp": gold.intersect(got), "fn": gold.subtract(got), "fp": got.subtract(gold)}
    out = None
    for kind, rows in kinds.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_ALIASES = [("AAA", ["Alpha Corp", "Alpha"]), ("BBB", ["Beta Inc", " ", "Beta"]), ("CCC", ["Gamma"])]


_PICKS = [(1, " aaa "), (2, "N/A"), (3, "zzz"), (4, None), (5, "CCC"), (6, "unknown")]
_PICK_SQL = f"(select id, pick, case when pick is null or upper(trim(pick)) in ('NULL', 'NONE', 'N/A', 'NA', 'UNKNOWN', '') then 'unknown' when upper(trim(pick)) in ('AAA', 'BBB', 'CCC') then 'resolved' else 'off_list' end as outcome from {sql_values(_PICKS, 'id, pick')})"


def _picks(spark: S) -> DataFrame:
    slate = values(spark, [(t,) for t, _ in _ALIASES], "ticker string").withColumn("listed", F.lit(True))
    return op.normalize_picks(values(spark, _PICKS, "id int, pick string"), slate)


@register("resolve_outcome", f"select user_id % 6 + 1 as pick_id, case when event_type = 'error' then 'empty_mention' when event_type = 'signup' then 'truncated' else outcome end as outcome, count(*) as n from events join {_PICK_SQL} on id = user_id % 6 + 1 group by all")
def resolve_outcome(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("id", (F.col("user_id") % 6 + 1).cast("int")).join(F.broadcast(_picks(spark)), "id")
    out = F.when(F.col("event_type") == "error", "empty_mention").when(F.col("event_type") == "signup", "truncated").otherwise(F.col("outcome"))
    return e.groupBy((F.col("user_id") % 6 + 1).alias("pick_id"), out.alias("outcome")).agg(F.count("*").alias("n"))


@register("candidate_prompt", "select n_regionkey, string_agg(n_nationkey || '. ' || n_name, chr(10) order by n_nationkey) as prompt from nation group by n_regionkey")
def candidate_prompt(spark: S, d: str) -> DataFrame:
    line = F.concat_ws(". ", F.col("n_nationkey"), F.col("n_name"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("x"))
    return rows.select("n_regionkey", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("prompt"))


@register("index_size", "select count(distinct c_mktsegment) as tickers, count(*) as aliases from customer")
def index_size(spark: S, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count_distinct("c_mktsegment").alias("tickers"), F.count("*").alias("aliases"))


@register("format_context", f"with {_DENSE_SQL} select query_id, string_agg('## ' || label || chr(10) || 'v' || doc_id, chr(10) || chr(10) order by rank) as context from densek join embeddings on vec_id = doc_id where rank <= 5 group by query_id")
def format_context(spark: S, d: str) -> DataFrame:
    part = F.concat(F.lit("## "), F.col("label"), F.lit("\n"), F.lit("v"), F.col("doc_id"))
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    rows = _dense(spark, d).where("rank <= 5").join(lab, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["part"]), "\n\n").alias("context"))
