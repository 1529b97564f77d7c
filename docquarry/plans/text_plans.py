"""Scalar functions, outcome chains and citation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import keys, outcomes, text
from docquarry.operators import citations
from docquarry.plans.common import sql_values, table, values
from docquarry.plans.registry import register

S = SparkSession


@register("normalize_ws", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents")
def normalize_ws(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_ws(F.col("text")).alias("t"))


@register("xml_escape", "select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t from pages")
def xml_escape(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.xml_escape(F.col("html")).alias("t"))


@register("mask_credentials", "select page_id, replace(url, '://', '://user:key@') as raw, regexp_replace(replace(url, '://', '://user:key@'), '//[^@/]+@', '//***@') as masked from pages")
def mask_credentials(spark: S, d: str) -> DataFrame:
    raw = F.replace(F.col("url"), F.lit("://"), F.lit("://user:key@"))
    return table(spark, d, "pages").select("page_id", raw.alias("raw"), text.mask_credentials(raw).alias("masked"))


@register("token_count", "select doc_id, ceil(length(text) / 4.0)::int as tokens from documents")
def token_count(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@register("route_by_tokens", "select doc_id, case when ceil(length(text) / 4.0) >= 1000 then case when doc_id % 5 = 0 then 'error' else 'retrieval' end else 'single_shot' end as route from documents")
def route_by_tokens(spark: S, d: str) -> DataFrame:
    route = outcomes.token_route(F.col("text"), F.col("doc_id") % 5 != 0, 1000)
    return table(spark, d, "documents").select("doc_id", route.alias("route"))


#: A routing dimension (worker, task, model tier).
_ROUTES = [("filing", "view", "small"), ("filing", "click", "small"), ("call", "purchase", "medium"), ("critic", "signup", "large"), ("critic", "error", "local/large")]


@register("route_model", f"select event_id, model, starts_with(model, 'local/') as is_local from events join {sql_values(_ROUTES, 'worker, task, model')} on task = event_type")
def route_model(spark: S, d: str) -> DataFrame:
    routes = F.broadcast(values(spark, _ROUTES, "worker string, event_type string, model string"))
    routed = table(spark, d, "events").join(routes, "event_type", "left")
    model = F.coalesce(F.col("model"), F.raise_error(F.lit("no model is routed for a task")).cast("string"))
    return routed.select("event_id", model.alias("model")).withColumn("is_local", F.startswith("model", F.lit("local/")))


@register("http_classify", "select event_id, case when user_id % 10 = 0 then 'rate_limited' when user_id % 10 = 1 then 'server_error' when user_id % 10 = 2 then 'client_error' when value < 5 then 'empty' else 'ok' end as outcome, user_id % 10 in (0, 1) or (user_id % 10 <> 2 and value < 5) as retryable from events")
def http_classify(spark: S, d: str) -> DataFrame:
    status = F.when(F.col("user_id") % 10 == 0, 429).when(F.col("user_id") % 10 == 1, 503).when(F.col("user_id") % 10 == 2, 404).otherwise(200)
    out = outcomes.http_outcome(status, F.when(F.col("value") < 5, 0).otherwise(1))
    return table(spark, d, "events").select("event_id", out.alias("outcome")).withColumn("retryable", outcomes.worth_retrying(F.col("outcome")))


_CONTENT_SQL = "(select doc_id, case when doc_id % 3 = 0 then 'Operator: hi <b>x</b> operator : a Operator:' || repeat(text, 8) when doc_id % 3 = 1 then 'Q & A ' || text else text end as c from documents)"


@register("classify_8k", rf"select doc_id, case when ops >= 3 and strlen(c) >= 30000 then 'transcript' when ops > 0 or qa then 'mixed' else 'press_release' end as kind, ops::int as operators, qa as has_qa from (select *, len(regexp_extract_all(t, '(?i)\bOperator\s*:')) as ops, regexp_matches(t, '(?i)(question.{{0,5}}and.{{0,5}}answer|q\s*[&-]\s*a)') as qa from (select doc_id, c, regexp_replace(c, '<[^>]+>', ' ', 'g') as t from {_CONTENT_SQL}))")
def classify_8k(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    c = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Operator: hi <b>x</b> operator : a Operator:"), F.repeat(t, F.lit(8)))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Q & A "), t)).otherwise(t)
    return table(spark, d, "documents").select("doc_id", text.classify_exhibit(c).alias("x")).select("doc_id", "x.*")


@register("earnings_8k_latest", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders where o_orderpriority in ('1-URGENT', '2-HIGH')) where r = 1")
def earnings_8k_latest(spark: S, d: str) -> DataFrame:
    items = F.transform(F.split(F.concat(F.lit("9.01, "), F.col("o_orderpriority")), ","), lambda x: F.trim(x))
    hit = table(spark, d, "orders").where(F.arrays_overlap(items, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))
    best = hit.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey"))
    return best


@register("validate_dimension", r"select n_nationkey, regexp_full_match(n_name, '[A-Z][A-Z0-9.\-]*') and length(n_name) <= 8 as ok from nation")
def validate_dimension(spark: S, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", (F.rlike("n_name", F.lit(r"^[A-Z][A-Z0-9.\-]*\z")) & (F.length("n_name") <= 8)).alias("ok"))


@register("context_drop_reason", "select doc_id, case when doc_id % 17 = 0 or coalesce(trim(text), '') = '' then 'empty' when doc_id % 13 = 0 then 'bad_stop' when ceil(length(text) / 4.0) > 100 then 'over_cap' else 'keep' end as reason from documents")
def context_drop_reason(spark: S, d: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 17 == 0, F.lit("  ")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", outcomes.context_outcome(given, F.col("doc_id") % 13 != 0).alias("reason"))


@register("key_normalize", "select s_suppkey, lpad(s_suppkey::varchar, 10, '0') as cik, replace('0001-23-' || s_suppkey, '-', '') as accession, 'S' || s_suppkey || '-2024Q' || (s_suppkey % 4 + 1) as doc from supplier")
def key_normalize(spark: S, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", keys.pad_cik(s).alias("cik"), keys.bare_accession(F.concat(F.lit("0001-23-"), s)).alias("accession"), keys.transcript_id(F.concat(F.lit("s"), s), F.lit(2024), s % 4 + 1).alias("doc"))


_TITLE_SQL = "(select n_nationkey, n_name || ' Q' || (n_nationkey % 4 + 1) || case n_nationkey % 3 when 0 then ' FY25' when 1 then ' 2026' else ' 2019' end as title from nation)"


@register("title_match", f"select n_nationkey, contains(lower(title), 'q2') and (contains(lower(title), '2026') or contains(lower(title), 'fy25')) as ok from {_TITLE_SQL}")
def title_match(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    title = F.concat(F.col("n_name"), F.lit(" Q"), k % 4 + 1, F.when(k % 3 == 0, " FY25").when(k % 3 == 1, " 2026").otherwise(" 2019"))
    return n.select("n_nationkey", text.title_matches(title, F.col("n_name"), F.lit("zz"), F.lit(2026), F.lit(2)).alias("ok"))


_CALL_SQL = "(select conv_id, string_agg(text, chr(10) order by turn) as t from (select conv_id, turn, case when turn = 2 then 'We will now begin the Q&A session. ' || text when turn = 1 and conv_id % 2 = 0 then 'Question-and-Answer Session ' || text else text end as text from conversations) group by conv_id)"
_QA1, _QA2 = r"(?i)\bQuestion[-\s]and[-\s]Answer\s+Session\b", r"(?i)\bWe(?:''ll| will)\s+now\s+(?:begin|move)\s+(?:the\s+)?Q\s*&\s*A\b"


@register("split_qa", rf"select conv_id, regexp_replace(case when cut is null then t else substr(t, 1, cut) end, '^\s+|\s+$', '', 'g') as prepared, case when cut is null then '' else regexp_replace(substr(t, cut + 1), '^\s+|\s+$', '', 'g') end as qa from (select *, coalesce(case when regexp_matches(t, '{_QA1}') then length(regexp_split_to_array(t, '{_QA1}')[1]) end, case when regexp_matches(t, '{_QA2}') then length(regexp_split_to_array(t, '{_QA2}')[1]) end) as cut from {_CALL_SQL})")
def split_qa(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    t = F.when(F.col("turn") == 2, F.concat(F.lit("We will now begin the Q&A session. "), F.col("text"))).when((F.col("turn") == 1) & (F.col("conv_id") % 2 == 0), F.concat(F.lit("Question-and-Answer Session "), F.col("text"))).otherwise(F.col("text"))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("t"))
    return whole.select("conv_id", text.split_qa(F.col("t")).alias("s")).select("conv_id", "s.*")


_FIELDS = [("tone", "the tone"), ("risk", "new risks"), ("concern", "going concern")]


@register("prompt_expand", f"select doc_id, 'Extract ' || f || ': ' || g as prompt from documents, {sql_values(_FIELDS, 'f, g')}")
def prompt_expand(spark: S, d: str) -> DataFrame:
    fields = F.broadcast(values(spark, _FIELDS, "f string, g string"))
    return table(spark, d, "documents").select("doc_id").join(fields).select("doc_id", text.fill_template(F.lit("Extract {f}: {g}"), {"f": F.col("f"), "g": F.col("g")}).alias("prompt"))


_HITS_SQL = "(select b.item_id, d.doc_id, b.text as q, d.text as t, len(string_split(d.text, b.text)) - 1 as n from benchmark b, documents d where contains(d.text, b.text))"


@register("char_span_check", f"select item_id, doc_id, strpos(t, q)::int - 1 as start, strpos(t, q)::int - 1 + length(q)::int as stop, substr(t, strpos(t, q), length(q)) = q as ok from {_HITS_SQL}")
def char_span_check(spark: S, d: str) -> DataFrame:
    found = citations.occurrence_table(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")))
    return found.where("ordinal = 0").select("item_id", "doc_id", "start", "stop", citations.grounded(F.col("text"), F.col("start"), F.col("stop"), F.col("quote")).alias("ok"))


_CLAIMS_SQL = r"""c as (select doc_id, text, unnest([1, 2, 3, 4, 5, 6]) as ordinal, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents),
q as (select doc_id, text, ordinal, case when ordinal <= 2 then array_to_string(w[2:7], ' ') when ordinal <= 4 and doc_id % 2 = 0 then w[1] || '  ' || w[2] when ordinal = 5 then 'no such words' when ordinal = 6 then ' ' end as quote from c),
d as (select * from q where ordinal <> 2 or doc_id % 3 = 0)"""


@register(
    "resolve_spans",
    rf"""with {_CLAIMS_SQL}, n as (select *, count(*) over (partition by doc_id, quote) as asked, row_number() over (partition by doc_id, quote order by ordinal) as i, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(quote, ''), '\s+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '\s+') as p from d),
    m as (select *, case when p = '' then [] else regexp_extract_all(text, p) end as hits, regexp_split_to_array(text, case when p = '' then 'zzzzzz' else p end) as pieces from n),
    o as (select *, case when p = '' then 'empty' when len(hits) = 0 then 'not_found' when len(hits) < asked then 'insufficient' when len(hits) > asked then 'ambiguous' else 'ok' end as outcome from m),
    s as (select *, case when outcome = 'ok' then (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::int end as start from o)
    select doc_id, ordinal, outcome, start, start + length(hits[i])::int as stop, case when outcome = 'ok' then hits[i] end as snapped from s""",
)
def resolve_spans(spark: S, d: str) -> DataFrame:
    """Up to six claims a document: its words 2 to 7, once or twice; its first two words, spelled with more white space; words that don't
    occur; blanks; none."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    w, k = text.quote_words(F.col("text")), F.col("ordinal")
    claims = docs.select("doc_id", w.alias("w"), F.explode(F.array(*map(F.lit, range(1, 7)))).alias("ordinal"))
    quote = (
        F.when(k <= 2, F.array_join(F.slice("w", 2, 6), " ")).when((k <= 4) & (F.col("doc_id") % 2 == 0), F.concat(F.get("w", F.lit(0)), F.lit("  "), F.get("w", F.lit(1))))
        .when(k == 5, "no such words").when(k == 6, " ")
    )
    claims = claims.where((k != 2) | (F.col("doc_id") % 3 == 0)).select("doc_id", "ordinal", quote.alias("quote"))
    return citations.resolve_quotes(docs, claims).drop("quote")


@register("citation_grounding", "select doc_id, case when doc_id % 4 = 0 then 'claim.1' when doc_id % 6 = 0 then 'claim.0' end as first_failure from documents")
def citation_grounding(spark: S, d: str) -> DataFrame:
    def claim(start: int, wrong: Column) -> Column:
        quote = F.substring("text", start + 1, 10)
        return F.struct(F.lit(start).alias("start"), F.lit(start + 10).alias("stop"), F.when(wrong, F.concat(quote, F.lit("~"))).otherwise(quote).alias("quote"))

    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    claims = F.array(claim(0, (F.col("doc_id") % 6 == 0) & (F.col("doc_id") % 4 != 0)), claim(20, F.col("doc_id") % 4 == 0))
    return docs.select("doc_id", citations.first_failure(F.col("text"), claims, "claim").alias("first_failure"))


@register("usage_map", "select event_id, case when value < 50 then 1 else 2 end::int as n_keys from events")
def usage_map(spark: S, d: str) -> DataFrame:
    m = outcomes.usage({"input": F.col("value"), "cached": F.when(F.col("value") >= 50, F.col("value"))})
    return table(spark, d, "events").select("event_id", F.size(m).alias("n_keys"))


@register("blocks_join", "select conv_id, string_agg(text, ' ' order by turn) filter (where role = 'assistant') as joined, (array_agg(turn order by turn) filter (where role = 'user'))[1] as first_user from conversations group by conv_id")
def blocks_join(spark: S, d: str) -> DataFrame:
    b = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("b"))
    joined = outcomes.joined_text(F.col("b"), "role", F.lit("assistant"))
    return b.select("conv_id", joined.alias("joined"), F.get(F.filter("b", lambda x: x["role"] == "user"), 0)["turn"].alias("first_user"))


@register("extraction_features", "select conv_id, count(*) filter (where role = 'assistant') as n_assistant, sum(case when turn % 3 = 0 then 1.0 when turn % 3 = 1 then 0.6 else 0.3 end * case when role = 'user' then 1 else -1 end)::double as tone from conversations group by conv_id")
def extraction_features(spark: S, d: str) -> DataFrame:
    from docquarry.functions.numbers import confidence_number

    level = F.when(F.col("turn") % 3 == 0, "high").when(F.col("turn") % 3 == 1, "medium").otherwise("low")
    signed = confidence_number(level).cast("decimal(10,1)") * F.when(F.col("role") == "user", 1).otherwise(-1)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.sum(signed).cast("double").alias("tone"))
