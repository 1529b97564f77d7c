"""Injected calls, versioned stores and read-only access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import calls, readers, store
from docquarry.plans.common import table, values
from docquarry.plans.registry import register
from docquarry.plans.retrieval_plans import _BM25_SQL
from docquarry.session import shared_dir
from docquarry.sources import files

S = SparkSession
FREE = calls.Policy(usd=float("inf"), failures=1 << 62, retries=1, sleep=lambda s: None)


def _get(url: str) -> bytes:
    """A stand-in for a server: some addresses are busy, some have nothing."""
    n = int(url.rsplit("/", 1)[1])
    if n % 7 == 0:
        raise calls.Retryable("busy", 2.0)
    if n % 11 == 0:
        raise calls.NoCoverage("nothing there")
    return url.encode()


@register("audio_source", "select c_custkey, case when c_custkey % 3 = 0 then 'direct' when c_custkey % 5 = 0 then 'search' end as source, case when c_custkey % 3 = 0 then 'https://a/' || c_name || '.mp3' when c_custkey % 5 = 0 then 'https://v/' || c_custkey end as url from customer")
def audio_source(spark: S, d: str) -> DataFrame:
    sources = {"direct": lambda r: f"https://a/{r['c_name']}.mp3" if r["c_custkey"] % 3 == 0 else None, "search": lambda r: f"https://v/{r['c_custkey']}" if r["c_custkey"] % 5 == 0 else None}
    got = calls.first_source(table(spark, d, "customer").select("c_custkey", "c_name"), sources)
    return got.select("c_custkey", F.col("audio_source").alias("source"), F.col("audio_url").alias("url"))


@register("transcribe", r"select conv_id, coalesce(string_agg(t, chr(10) order by turn) filter (where t <> ''), '') as transcript from (select conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from conversations) group by conv_id")
def transcribe(spark: S, d: str) -> DataFrame:
    segments = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("audio"))
    return calls.transcribe(segments, "conv_id", "turn", "audio", lambda b: b.decode())


@register("score_passages", "select conv_id, turn, (length(coalesce(text, '')) - length(role))::double as scorer_score from conversations")
def score_passages(spark: S, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return calls.score(hits, "role", "text", lambda q, t: [len(b) - len(a) for a, b in zip(q, t)]).select("conv_id", "turn", "scorer_score")


@register("encode_texts", "select doc_id, 8 as dim, 1.0::double as norm from documents")
def encode_texts(spark: S, d: str) -> DataFrame:
    got = calls.encode(table(spark, d, "documents").select("doc_id", "text"), "text", calls.hash_encoder(8), "document", 8)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return got.select("doc_id", F.size("vector").alias("dim"), F.round(norm, 6).alias("norm"))


def _extractor(text: str) -> tuple[object, float]:
    if not text:
        return None, 0.0
    return ([len(text)] if len(text) % 10 == 3 else {"n": len(text), "quote": text[:10]}), 0.25


def _check(record: dict, text: str) -> list[str]:
    return ["too_long"] if record["n"] > 2000 else [] if text.startswith(record["quote"]) else ["not_found"]


_EXTRACT_SQL = "select doc_id, lang as worker, case when coalesce(text, '') = '' then 'skipped' when length(text) % 10 = 3 then 'quarantined' when length(text) > 2000 then 'quarantined' else 'persisted' end as outcome, case when coalesce(text, '') = '' then null when length(text) % 10 = 3 then 'not an object' when length(text) > 2000 then 'too_long' end as problem, case when coalesce(text, '') = '' then 0.0::double else 0.25::double end as usd from documents"


def _extracted(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("worker"), "text")
    return calls.extract(docs, "text", _extractor, _check, FREE)


@register("extract_worker", _EXTRACT_SQL)
def extract_worker(spark: S, d: str) -> DataFrame:
    return _extracted(spark, d).select("doc_id", "worker", "outcome", F.get("problems", F.lit(0)).alias("problem"), "usd")


@register("quarantine_records", f"select case when outcome = 'persisted' then 'extracted' else 'quarantine' end as sink, worker, outcome, count(*) as n from ({_EXTRACT_SQL}) group by all")
def quarantine_records(spark: S, d: str) -> DataFrame:
    """Records written to their sinks by worker, and read back."""
    at = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    store.write_outcomes(_extracted(spark, d), at)
    out = None
    for sink in ("extracted", "quarantine"):
        one = spark.read.schema("doc_id long, outcome string, worker string").json(f"{at}/{sink}").groupBy("worker", "outcome").agg(F.count("*").alias("n")).select(F.lit(sink).alias("sink"), "worker", "outcome", "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("contextualise", "with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, case when text in (select text from t where doc_id % 3 = 0) then 'cached' else 'about ' || length(text) end as context from t")
def contextualise(spark: S, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", F.sha2("text", 256).alias("cache_key"), "text")
    cache = chunks.where("doc_id % 3 = 0").select("cache_key").distinct().withColumn("payload", F.lit("cached"))
    return calls.contextualise(chunks, "text", "cache_key", lambda t: f" about {len(t)} ", cache)[0].select("doc_id", "context")


@register("batch_results", "select o_orderkey as custom_id, coalesce(status, 'pending') as status, payload from orders left join (select l_orderkey, arg_min(l_returnflag, l_linenumber) as status, arg_min(l_linenumber, l_linenumber)::varchar as payload from lineitem where l_quantity > 45 group by l_orderkey having count(distinct l_returnflag) = 1) on l_orderkey = o_orderkey")
def batch_results(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("custom_id"), F.col("l_returnflag").alias("status"), F.col("l_linenumber").cast("string").alias("payload"), F.col("l_linenumber").alias("arrival"))
    same = li.groupBy("custom_id").agg(F.count_distinct("status").alias("n")).where("n = 1")
    return calls.batch_outcomes(table(spark, d, "orders").select(F.col("o_orderkey").alias("custom_id")), li.join(same, "custom_id", "left_semi"))


def _rows(spark: S, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "narrative").otherwise("financial").alias("chunk_type")
    return table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_id"), kind, F.length("text").alias("chars"), F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("vector"), F.lit("space-a").alias("embed_space"))


def _store(spark: S) -> store.Store:
    return store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@register("store_upsert", "select doc_id, case when lang = 'en' then 'narrative' else 'financial' end as chunk_type, case when doc_id % 5 = 0 then -1 else length(text) end::int as chars, lang = 'en' as in_corpus from documents")
def store_upsert(spark: S, d: str) -> DataFrame:
    """A version written twice, the second time for some documents only; its rows, and which of them the corpus holds."""
    s = _store(spark)
    s.write(_rows(spark, d), "v1")
    s.write(_rows(spark, d).where("doc_id % 5 = 0").withColumn("chars", F.lit(-1)), "v1")
    inside = s.corpus("v1").select("doc_id", F.lit(True).alias("in_corpus"))
    return s.read("v1").select("doc_id", "chunk_type", "chars").join(inside, "doc_id", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


_FINANCIALS = "with big as (select c_nationkey, c_acctbal from customer where c_acctbal > 0) select n_name, count(*) as n, round(sum(c_acctbal), 2) as total from big join nation on n_nationkey = c_nationkey group by n_name"


@register("query_financials", _FINANCIALS)
def query_financials(spark: S, d: str) -> DataFrame:
    return readers.read_only_sql(spark, _FINANCIALS, {t: table(spark, d, t) for t in ("customer", "nation")})


@register("memo_search", f"with {_BM25_SQL.replace('from lex qualify', 'from lex where doc_id % 3 = 1 qualify')} select query_id, doc_id as memo_id, rank from lexk where rank <= 5")
def memo_search(spark: S, d: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 1, "approved").otherwise("draft")
    memos = table(spark, d, "documents").select(F.col("doc_id").alias("memo_id"), "text", status.alias("status"))
    asked = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return readers.memo_search(memos, asked, 5).select("query_id", "memo_id", "rank")


@register("health_status", "select n_regionkey, case max(r) when 0 then 'ok' when 1 then 'warn' else 'error' end as status, coalesce(string_agg(n_name, ',' order by n_name) filter (where r > 0), '') as failing from (select *, case n_nationkey % 5 when 0 then 1 when 1 then 2 else 0 end as r from nation) group by n_regionkey")
def health_status(spark: S, d: str) -> DataFrame:
    status = F.when(F.col("n_nationkey") % 5 == 0, "warn").when(F.col("n_nationkey") % 5 == 1, "down").otherwise("ok")
    return readers.worst(table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("name"), status.alias("status")), "n_regionkey")


@register("listing_files", "select n_nationkey::bigint as cik, '8-K' as form, 'a-' || n_nationkey as accession, n_name as document from nation")
def listing_files(spark: S, d: str) -> DataFrame:
    """Listings landed as one JSON file each, read back and unnested."""
    at = f"{shared_dir(spark)}/listings-{uuid.uuid4().hex}"
    one = F.struct(F.array(F.lit("8-K"), F.lit("4")).alias("forms"), F.array(F.concat(F.lit("a-"), "n_nationkey"), F.lit("b")).alias("accessions"), F.array("n_name", F.lit("c")).alias("documents"))
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("cik"), one.alias("filings")))
    table(spark, d, "nation").select(doc.alias("value"), F.col("n_nationkey").alias("part")).repartition("part").write.partitionBy("part").text(at)
    return files.unnest_listing(files.scan_listings(spark, at), ["8-K"])


@register("audio_gate", "select event_id, case when event_id % 40 < 4 then 'too_small' when event_id % 3 = 0 then 'ok' else 'not_audio' end as outcome from events")
def audio_gate(spark: S, d: str) -> DataFrame:
    head = F.when(F.col("event_id") % 3 == 0, F.lit("ID3")).otherwise(F.lit("<ht"))
    content = F.concat(head, F.repeat(F.lit("x"), (F.col("event_id") % 40).cast("int"))).cast("binary")
    return table(spark, d, "events").select("event_id", files.audio_outcome(content, 7).alias("outcome"))


def _citing(text: str) -> tuple[object, float]:
    words = (text or "").split()
    cited = [" ".join(words[1:7])] + ([" ".join(words[:2])] if len(text) % 3 == 0 else [])
    return {"citations": [{"source_quote": q} for q in cited]} | ({"extra": 1} if len(text) % 7 == 0 else {}), 0.0


@register(
    "worker_spans",
    r"""with c as (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents where text <> ''),
    q as (select doc_id, text, unnest(case when length(text) % 3 = 0 then [0, 1] else [0] end) as ordinal, w from c), r as (select doc_id, text, ordinal, case when ordinal = 0 then w[2:7] else w[1:2] end as w from q),
    g as (select *, count(*) over (partition by doc_id, array_to_string(w, ' ')) as asked, array_to_string(list_transform(w, lambda x: regexp_escape(x)), '\s+') as p from r),
    o as (select doc_id, text, case when p = '' then false else len(regexp_extract_all(text, p)) = asked end as ok from g)
    select doc_id, case when any_value(length(text)) % 7 = 0 or not bool_and(ok) then 'quarantined' else 'persisted' end as outcome from o group by doc_id""",
)
def worker_spans(spark: S, d: str) -> DataFrame:
    """A worker whose records cite one or two quotes, some of which occur more than once, and some of whose records have a field too many."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    return calls.cited_worker(docs, "text", "doc_id", _citing, ("citations",), FREE).select("doc_id", "outcome")


@register("document_files", "select n_nationkey, strlen(n_name)::bigint as bytes, sha256(n_name) as content_sha256 from nation")
def document_files(spark: S, d: str) -> DataFrame:
    """Raw files landed one by one, scanned with their digests."""
    at = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation").select("n_name", "n_nationkey").repartition("n_nationkey")
    rows.write.option("lineSep", "\u001e").partitionBy("n_nationkey").text(at)
    got = files.scan_documents(spark, at).where("path like '%part-%'")
    body = F.expr("substring(content, 1, length(content) - 1)")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), (F.col("length") - 1).alias("bytes"), F.sha2(body, 256).alias("content_sha256"))


@register("feature_scan", "select user_id, count(*) as n, round(sum(value), 4) as total from events where event_type = 'view' group by user_id")
def feature_scan(spark: S, d: str) -> DataFrame:
    """Feature rows written and scanned as a source that must have its time columns."""
    at = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    t = F.col("ts").cast("timestamp")
    table(spark, d, "events").where("event_type = 'view'").select("user_id", "value", t.alias("event_datetime"), (t + F.expr("interval 1 day")).alias("as_of_ts")).write.parquet(at)
    return files.scan_features(spark, at).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
