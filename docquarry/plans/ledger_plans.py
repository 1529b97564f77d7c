"""Sources, ledger, caches, versions and control queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import keys, numbers, outcomes, text
from docquarry.operators import ledger as op
from docquarry.plans.common import LEDGER_SQL, ledger, sql_values, table, values
from docquarry.plans.registry import register
from docquarry.sources import files

S = SparkSession


@register("manifest_scan", f"select source, status, count(*) as n, count(distinct content_sha256) as contents from {LEDGER_SQL} group by all")
def manifest_scan(spark: S, d: str) -> DataFrame:
    return ledger(spark, d).groupBy("source", "status").agg(F.count("*").alias("n"), F.count_distinct("content_sha256").alias("contents"))


@register("incremental_fetch", f"select doc_id, source from (select doc_id, source, row_number() over (partition by doc_id order by position) as r from (select doc_id, source, doc_id as position from documents union all select doc_id, source, doc_id + 1000000 as position from documents where doc_id % 3 = 0)) where r = 1 and doc_id not in (select doc_id from {LEDGER_SQL} where status = 'ok')")
def incremental_fetch(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    listing = docs.select("doc_id", "source", F.col("doc_id").alias("position")).unionByName(docs.where("doc_id % 3 = 0").select("doc_id", "source", (F.col("doc_id") + 1_000_000).alias("position")))
    return op.incremental(listing, ledger(spark, d)).select("doc_id", "source")


@register(
    "transcript_outcome",
    f"""select d.doc_id, case when l.doc_id is not null then 'cached' when d.source in ('src1', 'src2') then 'unregistered' when d.doc_id % 5 = 0 then 'error' when d.doc_id % 2 = 0 then 'ok' else 'no_coverage' end as outcome
    from (select distinct doc_id, source from documents) d left join (select distinct source, doc_id from {LEDGER_SQL} where status = 'ok' and doc_id % 3 = 0) l on l.doc_id = d.doc_id and l.source = d.source""",
)
def transcript_outcome(spark: S, d: str) -> DataFrame:
    """Calls asked of their sources, some of which the ledger holds as ok, some of whose sources aren't registered."""
    held = ledger(spark, d).where("status = 'ok' and doc_id % 3 = 0").select("source", "doc_id").distinct().withColumn("held", F.lit(True))
    asked = table(spark, d, "documents").select("doc_id", "source").distinct().join(held, ["source", "doc_id"], "left")
    out = outcomes.transcript_outcome(F.col("held"), ~F.col("source").isin("src1", "src2"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 == 0)
    return asked.select("doc_id", out.alias("outcome"))


@register("url_template", "select s_suppkey, replace(replace('https://calls.example.org/{ticker}/{quarter}.mp3', '{ticker}', 'S' || s_suppkey), '{quarter}', cast(s_suppkey % 4 + 1 as varchar)) as url from supplier")
def url_template(spark: S, d: str) -> DataFrame:
    url = text.fill_template(F.lit("https://calls.example.org/{ticker}/{quarter}.mp3"), {"ticker": F.concat(F.lit("S"), F.col("s_suppkey")), "quarter": F.col("s_suppkey") % 4 + 1})
    return table(spark, d, "supplier").select("s_suppkey", url.alias("url"))


@register("first_match", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id) as r from events where value between 10 and 40 and event_type = 'view') where r = 1")
def first_match(spark: S, d: str) -> DataFrame:
    hit = table(spark, d, "events").where(F.col("value").between(10, 40) & (F.col("event_type") == "view"))
    return op.first_seen(hit, "user_id", "event_id").select("user_id", "event_id", "value")


@register("dimension_load", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey <> 3")
def dimension_load(spark: S, d: str) -> DataFrame:
    return files.load_dimension(table(spark, d, "nation"), "n_nationkey").where("n_regionkey <> 3").select("n_nationkey", "n_name", "n_regionkey")


@register("registry_validate", "select distinct n_nationkey as nation from nation where n_nationkey not in (select distinct s_nationkey from supplier where s_nationkey < 20)")
def registry_validate(spark: S, d: str) -> DataFrame:
    used = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("nation")).distinct()
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).join(used, "nation", "left_anti")


@register(
    "first_10k",
    "select o_custkey, o_orderkey, substr(coalesce(nullif(rd, ''), fd), 1, 4) as fiscal_year from (select o_custkey, o_orderkey, case when o_orderkey % 2 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as rd, strftime(o_orderdate, '%Y-%m-%d') as fd, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders where o_orderstatus = 'F') where r = 1",
)
def first_10k(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("fd", F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = o.withColumn("rd", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("fd")))
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    year = F.substring(F.coalesce(F.nullif("rd", F.lit("")), F.col("fd")), 1, 4)
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", year.alias("fiscal_year"))


_IN_SQL = "(select source, doc_id, 'ok' as status from documents where doc_id % 5 = 0 union all select source, doc_id + 5000000, 'ok' from documents where doc_id % 5 = 0)"


@register("manifest_append", f"select source, status, count(*) as n, max(doc_id) as last_id from (select source, doc_id, status from {LEDGER_SQL} union all select * from {_IN_SQL} i where not exists (select 1 from {LEDGER_SQL} l where l.source is not distinct from i.source and l.doc_id is not distinct from i.doc_id and l.status is not distinct from i.status)) group by all")
def manifest_append(spark: S, d: str) -> DataFrame:
    some = table(spark, d, "documents").where("doc_id % 5 = 0")
    incoming = some.select("source", "doc_id", F.lit("ok").alias("status")).unionByName(some.select("source", (F.col("doc_id") + 5_000_000).alias("doc_id"), F.lit("ok").alias("status")))
    return op.append(ledger(spark, d).select("source", "doc_id", "status"), incoming).groupBy("source", "status").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))


@register("quarantine_split", "select case when quality = 1 and toxic = 0 then 'good' else 'quarantine' end as side, count(*) as n, sum(doc_id)::bigint as ids from labels group by side")
def quarantine_split(spark: S, d: str) -> DataFrame:
    side = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").otherwise("quarantine")
    return table(spark, d, "labels").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_KEYED_SQL = "(select doc_id, sha256(text || '|p1|s1|m1|{}') as cache_key from documents)"


@register("cache_key", f"select doc_id, cache_key from {_KEYED_SQL}")
def cache_key(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.cache_key(F.col("text"), F.lit("p1"), F.lit("s1"), F.lit("m1"), F.lit("{}")).alias("cache_key"))


@register("cache_lookup", f"select k.doc_id, c.cache_key is not null as hit, c.payload from {_KEYED_SQL} k left join (select cache_key, min(doc_id) as payload from {_KEYED_SQL} where doc_id % 2 = 0 group by cache_key) c using (cache_key)")
def cache_lookup(spark: S, d: str) -> DataFrame:
    keyed = cache_key(spark, d)
    cache = keyed.where("doc_id % 2 = 0").groupBy("cache_key").agg(F.min("doc_id").alias("payload"))
    return op.cache_split(keyed, cache).select("doc_id", "hit", "payload")


@register("staged_commit", "select l_orderkey, count(*) as n from lineitem group by l_orderkey having bool_and(l_quantity > 5)")
def staged_commit(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 5).alias("ok"))
    return op.staged(li, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("corpus_narrative", "select label, count(*) as n from embeddings where label in (0, 1, 2) group by label")
def corpus_narrative(spark: S, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("label").isin(0, 1, 2)).groupBy("label").agg(F.count("*").alias("n"))


@register("upsert_by_doc", "select doc_id, source, n_chars from documents where doc_id % 4 <> 0 union all select doc_id, 'new', n_chars + 1 from documents where doc_id % 4 = 0")
def upsert_by_doc(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return op.upsert(docs, docs.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars")))


@register("survey_counts", "select coalesce(n.n_name, 'no_nation') as class, count(*) as n from customer c left join (select * from nation where n_regionkey < 3) n on c.c_nationkey = n.n_nationkey group by class")
def survey_counts(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("no_nation")).alias("class")).agg(F.count("*").alias("n"))


@register("truncate_text", "select doc_id, case when length(text) > 512 then substr(text, 1, 512) || '...[truncated ' || (length(text) - 512) || ' more chars]' else text end as status from documents")
def truncate_text(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate_status(F.col("text")).alias("status"))


@register("manifest_contains", f"select a.doc_id, exists (select 1 from {LEDGER_SQL} l where l.source = a.source and l.doc_id = a.doc_id and l.status = 'ok') as found from (select source, doc_id from documents where doc_id % 3 = 0 union all select source, doc_id + 9000000 from documents where doc_id % 30 = 0) a")
def manifest_contains(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 3 = 0").select("source", "doc_id", F.lit("ok").alias("status")).unionByName(docs.where("doc_id % 30 = 0").select("source", (F.col("doc_id") + 9_000_000).alias("doc_id"), F.lit("ok").alias("status")))
    return op.contains(ledger(spark, d), asked).select("doc_id", "found")


@register("existing_doc_ids", f"select distinct doc_id from {LEDGER_SQL} where source = 'src3' and status = 'ok'")
def existing_doc_ids(spark: S, d: str) -> DataFrame:
    return ledger(spark, d).where("source = 'src3' and status = 'ok'").select("doc_id").distinct()


@register("candidate_filter", f"select doc_id, form_type from {LEDGER_SQL} where status = 'ok' and form_type in ('en', 'de') and source <> 'src0'")
def candidate_filter(spark: S, d: str) -> DataFrame:
    return ledger(spark, d).where("status = 'ok' and form_type in ('en', 'de') and source <> 'src0'").select("doc_id", "form_type")


@register("promotion_missing", f"select doc_id from {LEDGER_SQL} where status = 'ok' and doc_id not in (select vec_id from embeddings)")
def promotion_missing(spark: S, d: str) -> DataFrame:
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return ledger(spark, d).where("status = 'ok'").select("doc_id").join(held, "doc_id", "left_anti")


@register("promotion_uniform", "select label, count(distinct len(embedding)) as dims, count(distinct case when vec_id % 100 = 0 then 'v2' else 'v1' end) as stamps, count(*) as n from embeddings group by label")
def promotion_uniform(spark: S, d: str) -> DataFrame:
    stamp = F.when(F.col("vec_id") % 100 == 0, "v2").otherwise("v1")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count_distinct(F.size("embedding")).alias("dims"), F.count_distinct(stamp).alias("stamps"), F.count("*").alias("n"))


@register("promotion_gate", "select label, bool_or(vec_id % 50 = 0) as in_corpus, count(*) > 0 as not_empty, (bool_or(vec_id % 50 = 0) or label not in (0, 1)) and count(*) > 0 as passes from embeddings group by label")
def promotion_gate(spark: S, d: str) -> DataFrame:
    held, some = F.bool_or(F.col("vec_id") % 50 == 0), F.count("*") > 0
    return table(spark, d, "embeddings").groupBy("label").agg(held.alias("in_corpus"), some.alias("not_empty")).withColumn("passes", (F.col("in_corpus") | ~F.col("label").isin(0, 1)) & F.col("not_empty"))


@register("reembed_cost", "select source, count(*) as n, sum(ceil(length(text) / 4.0))::bigint as tokens, round(sum(ceil(length(text) / 4.0)) / 1000000.0 * 0.18, 9) as usd from documents where text is not null group by source")
def reembed_cost(spark: S, d: str) -> DataFrame:
    got = table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(text.estimated_tokens(F.col("text"))).alias("tokens"))
    return got.withColumn("usd", F.round(F.col("tokens") / F.lit(1_000_000.0) * 0.18, 9))


#: Price table (model, USD a million tokens in and out).
_RATES = [("large", 15.0, 75.0), ("medium", 3.0, 15.0), ("small", 1.0, 5.0)]
_USAGE_SQL = f"""(select l_orderkey, l_linenumber, l_quantity * 100 as tin, l_tax * 10000 as tread, l_discount * 1000 as tout, case when l_returnflag = 'A' then 'batch' else 'standard' end as tier, v.rin, v.rout,
 from lineitem join {sql_values(_RATES, 'm, rin, rout')} on m = case l_linestatus when 'O' then 'small' else 'medium' end)"""
_USD_SQL = "(tin / 1000000.0 * rin + tread / 1000000.0 * rin * 0.10 + 0.0 + tout / 1000000.0 * rout) * case when tier = 'batch' then 0.5 else 1 end"


def _usage(spark: S, d: str) -> DataFrame:
    rates = F.broadcast(values(spark, _RATES, "model string, rin double, rout double"))
    dated = F.concat(F.when(F.col("l_linestatus") == "O", "small").otherwise("medium"), F.lit("-20250101"))
    u = table(spark, d, "lineitem").withColumn("model", numbers.model_alias(dated)).join(rates, "model")
    tier = F.when(F.col("l_returnflag") == "A", "batch").otherwise("standard")
    usd = numbers.usd(F.col("l_quantity") * 100, F.col("l_tax") * 10000, F.lit(None).cast("double"), F.col("l_discount") * 1000, F.col("rin"), F.col("rout"), tier)
    return u.select("l_orderkey", "l_linenumber", usd.alias("usd"))


@register("usd_cost", f"select l_orderkey, l_linenumber, round({_USD_SQL}, 10) as usd from {_USAGE_SQL}")
def usd_cost(spark: S, d: str) -> DataFrame:
    return _usage(spark, d).withColumn("usd", F.round("usd", 10))


@register("cost_cap_running", "select event_id, coalesce(sum(cents) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) <= 3000 as allowed from (select event_id, user_id, floor(value * 10)::bigint as cents from events)")
def cost_cap_running(spark: S, d: str) -> DataFrame:
    u = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") * 10).alias("cents"))
    return op.running_cap(u, "user_id", "event_id", "cents", 3000).select("event_id", "allowed")


@register("batch_cost", "select l_returnflag as batch, count(*) as n, count(*) filter (where l_linestatus = 'O') as succeeded, sum(case when l_linestatus = 'O' then l_quantity else 0 end)::bigint as tokens, bool_and(l_linestatus = 'O') as all_succeeded from (select distinct on (l_orderkey, l_linenumber) * from (select * from lineitem union all select * from lineitem where l_orderkey % 10 = 0)) group by batch")
def batch_cost(spark: S, d: str) -> DataFrame:
    """Costs of batches whose jobs are partly sent twice. Of the rows of one job, the table's first counts: file by file, row by row.
    Tokens of a batch are rounded once, halves to even."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at.alias("at"), F.struct("l_returnflag", "l_linestatus", "l_quantity").alias("job"))
    once = li.unionByName(li.where("l_orderkey % 10 = 0")).groupBy("l_orderkey", "l_linenumber").agg(F.min_by("job", "at").alias("job")).select("job.*")
    ok = F.col("l_linestatus") == "O"
    return once.groupBy(F.col("l_returnflag").alias("batch")).agg(F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.rint(F.sum(F.when(ok, F.col("l_quantity")).otherwise(0))).cast("long").alias("tokens"), F.bool_and(ok).alias("all_succeeded"))


@register("outcome_counts", f"select form_type, count(*) filter (where status = 'ok') as persisted, count(*) filter (where status = 'error') as failed, count(*) filter (where status = 'no_coverage') as skipped from {LEDGER_SQL} group by form_type")
def outcome_counts(spark: S, d: str) -> DataFrame:
    one = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    return ledger(spark, d).groupBy("form_type").agg(one("ok", "persisted"), one("error", "failed"), one("no_coverage", "skipped"))


@register("best_exhibit", "select l_orderkey, l_linenumber, ops, size from (select l_orderkey, l_linenumber, cast(l_quantity as int) % 5 as ops, floor(l_extendedprice)::bigint as size, row_number() over (partition by l_orderkey order by cast(l_quantity as int) % 5 desc, floor(l_extendedprice)::bigint desc, l_linenumber) as r from lineitem) where r = 1 and (ops, size) > (0, 0)")
def best_exhibit(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("ops"), F.floor("l_extendedprice").alias("size"))
    best = li.where("ops > 0 or size > 0").groupBy("l_orderkey").agg(F.max(F.struct("ops", "size", (-F.col("l_linenumber")).alias("neg"))).alias("b"))
    return best.select("l_orderkey", (-F.col("b.neg")).alias("l_linenumber"), "b.ops", "b.size")


@register("identity_agreement", "select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end as l_returnflag, case when count(distinct l_linestatus) = 1 then min(l_linestatus) end as l_linestatus, concat_ws(',', case when count(distinct l_returnflag) > 1 then 'l_returnflag' end, case when count(distinct l_linestatus) > 1 then 'l_linestatus' end) as disagreeing from lineitem group by l_orderkey")
def identity_agreement(spark: S, d: str) -> DataFrame:
    return op.identity_agreement(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@register("circuit_breaker", """with e as (select user_id, event_id, event_type = 'error' as failed from events), r as (select *, sum(case when failed then 0 else 1 end) over (partition by user_id order by event_id) as run from e),
 s as (select *, case when failed then sum(failed::int) over (partition by user_id, run order by event_id) else 0 end as streak from r)
 select user_id, event_id, streak::bigint as streak, coalesce(max((streak >= 3)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) = 1 as open from s""")
def circuit_breaker(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return op.circuit_breaker(e, "user_id", "event_id", "failed", 3).select("user_id", "event_id", F.col("streak").cast("long").alias("streak"), "open")


@register("materialization_version", "select label, substr(sha256('c' || label || '|p1|e1'), 1, 8) as version, 'corpus__' || substr(sha256('c' || label || '|p1|e1'), 1, 8) as name from (select distinct label from embeddings)")
def materialization_version(spark: S, d: str) -> DataFrame:
    v = keys.materialization_version(F.concat(F.lit("c"), F.col("label")), F.lit("p1"), F.lit("e1"))
    return table(spark, d, "embeddings").select("label").distinct().select("label", v.alias("version"), keys.table_name(F.lit("corpus"), v).alias("name"))


@register("version_tokens", "select label, 'hash:m' || label || ':t1' as embed_space, 'rr:m' || label || ':t2' as rerank_space from (select distinct label from embeddings)")
def version_tokens(spark: S, d: str) -> DataFrame:
    m = F.concat(F.lit("m"), F.col("label"))
    return table(spark, d, "embeddings").select("label").distinct().select("label", keys.version_token(F.lit("hash"), m, F.lit("t1")).alias("embed_space"), keys.version_token(F.lit("rr"), m, F.lit("t2")).alias("rerank_space"))


@register("reembed_preserve", "select vec_id, label, 'e2' as embed_model_version, len(embedding)::int as dims, round(list_sum(list_transform(embedding, lambda x: x::double * 2)), 6) as total from embeddings")
def reembed_preserve(spark: S, d: str) -> DataFrame:
    new = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 2)).withColumn("embed_model_version", F.lit("e2"))
    return new.select("vec_id", "label", "embed_model_version", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("survey_outcome", "select c_custkey, case when n_name is null then 'no_cik' when n.orders is null then 'no_filings' when n.finished = 0 then 'no_earnings' when c_acctbal < 0 then 'fetch_error' else 'transcript' end as outcome from customer left join (select * from nation where n_regionkey < 4) on c_nationkey = n_nationkey left join (select o_custkey, count(*) as orders, count(*) filter (where o_orderstatus = 'F') as finished from orders group by o_custkey) n on o_custkey = c_custkey")
def survey_outcome(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    out = F.when(F.col("n_name").isNull(), "no_cik").when(F.col("orders").isNull(), "no_filings").when(F.col("finished") == 0, "no_earnings").when(F.col("c_acctbal") < 0, "fetch_error").otherwise("transcript")
    return table(spark, d, "customer").join(n, "c_nationkey", "left").join(o, "c_custkey", "left").select("c_custkey", out.alias("outcome"))


@register("contextual_key", """select doc_id, sha256('{"child":"' || lang || '","chunker":"c1","parent":"' || source || '"}' || '|p1|s1|m1|{}') as key from documents""")
def contextual_key(spark: S, d: str) -> DataFrame:
    raw = keys.canonical_json({"parent": F.col("source"), "child": F.col("lang"), "chunker": F.lit("c1")})
    return table(spark, d, "documents").select("doc_id", keys.cache_key(raw, F.lit("p1"), F.lit("s1"), F.lit("m1"), F.lit("{}")).alias("key"))


@register("canonical_json", """select event_id, '{"a":"' || event_type || '","b":' || user_id || '}' as j from events""")
def canonical_json(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", keys.canonical_json({"b": F.col("user_id"), "a": F.col("event_type")}).alias("j"))


@register("registry_drift", "select 'missing' as side, r_regionkey as key from region where r_regionkey not in (select n_regionkey from nation where n_nationkey < 4) union all select 'extra', k from (select distinct n_regionkey + 1 as k from nation) where k not in (select r_regionkey from region)")
def registry_drift(spark: S, d: str) -> DataFrame:
    r, n = table(spark, d, "region").select(F.col("r_regionkey").alias("key")), table(spark, d, "nation")
    missing = r.exceptAll(n.where("n_nationkey < 4").select(F.col("n_regionkey").alias("key")).distinct())
    extra = n.select((F.col("n_regionkey") + 1).alias("key")).distinct().exceptAll(r)
    return missing.select(F.lit("missing").alias("side"), "key").unionByName(extra.select(F.lit("extra").alias("side"), "key"))


@register("child_parent_join", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def child_parent_join(spark: S, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
