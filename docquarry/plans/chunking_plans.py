"""Section, table and chunk queries, and the streaming forms run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.operators import chunking as op
from docquarry.plans.common import table
from docquarry.plans.registry import register
from docquarry.session import shared_dir
from docquarry.streaming import state, streams

S = SparkSession


_TABLE = "<table><tr><td>1</td></tr><table><tr><td>2</td></tr></table></table>"
_PARTS = (
    '<h1>Report</h1><p>see Item 7 of this form</p><div><a href="#r">Legal Proceedings</a></div><p>Item 1. Business</p><p>',
    "</p><p>Item&nbsp;1A&#8212;Risk Factors</p><p>",
    f"</p>{_TABLE}<!-- Item 2. Properties --><p>Legal Proceedings</p><p>",
    "</p>",
)


def _filing(t: Column) -> Column:
    """Filing-like markup around a document's text, which has no headers or tables of its own: a reference, a link in a table of contents,
    headers with a full stop and with a dash written as an entity, nested tables, a header in a comment and one without its number."""
    return F.concat(F.lit(_PARTS[0]), t, F.lit(_PARTS[1]), t, F.lit(_PARTS[2]), t, F.lit(_PARTS[3]))


_FILING_SQL = " || text || ".join(f"'{x}'" for x in _PARTS)
_H = f"h as (select doc_id, {_FILING_SQL} as h from documents)"
#: Where headers stand and where the prose after them is looked for: 200 characters on after a number, right after a bare title.
_HEADERS_SQL = f"""{_H}, c as (select doc_id, h, unnest([{{'item': '1', 'pos': strpos(h, 'Item 1. Business') - 1, 'ahead': 200}}, {{'item': '1A', 'pos': strpos(h, 'Item&nbsp;1A') - 1, 'ahead': 200}}, {{'item': '3', 'pos': strpos(h, '<p>Legal Proceedings') + 2, 'ahead': 17}}]) as x from h),
 s as (select doc_id, h, x.item as item, x.pos as pos from c where length(regexp_replace(regexp_replace(regexp_replace(substr(h, x.pos + x.ahead + 1, 2000), '<[^>]+>', ' ', 'g'), '&[^;]+;', ' ', 'g'), '[^\\p{{L}}]', '', 'g')) >= 80),
 sec as (select doc_id, 'Item ' || item as section, pos::int as start, coalesce(lead(pos) over (partition by doc_id order by pos), length(h))::int as stop from s)"""


def _filings(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _filing(F.col("text")).alias("html"))


@register(
    "mask_comments",
    r"""select page_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(repeat(' ', length(m[i])), '')), '') as html
    from (select page_id, regexp_split_to_array(html, '(?s)<!--.*?-->') as p, regexp_extract_all(html, '(?s)<!--.*?-->') as m from pages)""",
)
def mask_comments(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.mask_comments(F.col("html")).alias("html"))


@register("item_headers", rf"with {_H} select doc_id, list_aggregate(regexp_extract_all(h, '\b(?i:item)(?:\s|&#160;|&nbsp;|&#x[Aa]0;)+(\d+[A-Za-z]?)\b', 1), 'string_agg', ',') as items from h")
def item_headers(spark: S, d: str) -> DataFrame:
    return _filings(spark, d).select("doc_id", F.array_join(op.item_headers(F.col("html")), ",").alias("items"))


@register("table_spans", f"with {_H} select doc_id, 0 as ordinal, (strpos(h, '<table>') - 1)::int as start, (strpos(h, '<table>') - 1 + {len(_TABLE)})::int as stop from h")
def table_spans(spark: S, d: str) -> DataFrame:
    return op.table_rows(_filings(spark, d)).withColumnRenamed("end", "stop")


@register("tag_depths", f"with {_H} select doc_id, i::int as ordinal, i >= 2 as closing, [1, 2, 1, 0][i + 1]::bigint as depth from h, range(4) as r(i)")
def tag_depths(spark: S, d: str) -> DataFrame:
    return op.tag_depths(_filings(spark, d), "doc_id", "html", "table")


@register("section_first", f"with {_HEADERS_SQL} select doc_id, item, min(pos)::int as first_real from s where item <> '3' group by all")
def section_first(spark: S, d: str) -> DataFrame:
    """Where each numbered item is first a real header."""
    return op.audit_items(_filings(spark, d)).where("first_real is not null").select("doc_id", "item", "first_real")


@register("section_tiling", f"with {_HEADERS_SQL} select doc_id, item, pos::int as start, coalesce(lead(pos) over (partition by doc_id order by pos), length(h))::int as stop from s where item <> '3'")
def section_tiling(spark: S, d: str) -> DataFrame:
    """Numbered headers' starts, tiled to the document's end by column expressions."""
    f = _filings(spark, d)
    starts = op.audit_items(f).where("first_real is not null").select("doc_id", "item", F.col("first_real").alias("start"))
    return op.tile(starts.join(f.select("doc_id", F.length("html").alias("length")), "doc_id"), "doc_id", "start", "length").select("doc_id", "item", "start", F.col("end").alias("stop"))


@register("trim_budget", f"with {_HEADERS_SQL} select doc_id, section, start, least(start + 500, stop) as stop from sec")
def trim_budget(spark: S, d: str) -> DataFrame:
    """Sections cut to a budget of 500 characters each."""
    return op.section_rows(_filings(spark, d)).select("doc_id", "section", "start", F.least(F.col("start") + 500, F.col("end")).alias("stop"))


@register("item_audit", f"with {_HEADERS_SQL}, n as (select item, count(*) as real from s group by item) select i.item, (select count(*) from documents) as candidates, coalesce(n.real, 0)::bigint as real, true as known from (values ('1'), ('1A'), ('7')) as i(item) left join n using (item)")
def item_audit(spark: S, d: str) -> DataFrame:
    """Of each item number: how often it is mentioned, and as a real header."""
    each = op.audit_items(_filings(spark, d))
    return each.groupBy("item").agg(F.sum("candidates").alias("candidates"), F.sum("real").alias("real"), F.bool_and("known").alias("known"))


@register("detect_sections", f"with {_HEADERS_SQL} select * from sec")
def detect_sections(spark: S, d: str) -> DataFrame:
    return op.section_rows(_filings(spark, d)).withColumnRenamed("end", "stop")


@register("parse_filing")
def parse_filing(spark: S, d: str) -> DataFrame:
    return op.parse_filings(_filings(spark, d))


@register("chunk_outcome", f"with {_HEADERS_SQL} select doc_id, case doc_id % 4 when 0 then 'not_implemented' when 1 then 'unsupported_doc_type' when 2 then 'no_sections' else case when exists (select 1 from sec where sec.doc_id = d.doc_id) then 'chunked' else 'no_sections' end end as outcome from documents d")
def chunk_outcome(spark: S, d: str) -> DataFrame:
    """The chunker's outcome by kind of document: one known without a detector, an unknown one, filings without headers, filings."""
    kinds = F.when(F.col("doc_id") % 4 == 0, "8-K").when(F.col("doc_id") % 4 == 1, "memo").otherwise("10-K")
    f = table(spark, d, "documents").withColumn("html", F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<p>"), "text", F.lit("</p>"))).otherwise(_filing(F.col("text"))))
    # atoms of any length, so that only headers decide
    return op.parse_filings(f.withColumn("kind", kinds), kind="kind", hard_child=1 << 30).select("doc_id", "outcome").distinct()


@register("table_narrative_tiles")
def table_narrative_tiles(spark: S, d: str) -> DataFrame:
    return parse_filing(spark, d).groupBy("doc_id", "from_table").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("pack_parents")
def pack_parents(spark: S, d: str) -> DataFrame:
    return parse_filing(spark, d).groupBy("doc_id", "section", "parent_start", "parent_end").agg(F.count("*").alias("children"))


@register("subdivide_children")
def subdivide_children(spark: S, d: str) -> DataFrame:
    return parse_filing(spark, d).select("doc_id", "outcome", "section", "start", "end", text.estimated_tokens(F.col("text")).alias("tokens"))


@register("stream_dedup", "select distinct user_id, event_type from events")
def stream_dedup(spark: S, d: str) -> DataFrame:
    return streams.run_to_end(streams.deduplicated(streams.event_stream(spark, d)), "docquarry_dedup")


def _ended(closed: DataFrame, still_open: DataFrame) -> DataFrame:
    """Windows that the stream closed and those open at its end, with times as microseconds."""
    both = closed.unionByName(still_open)
    return both.withColumns({c: F.unix_micros(c) for c in ("start", "end")})


@register(
    "stream_session",
    """with o as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 6 hours, true) as fresh from events),
    n as (select user_id, ts, sum(fresh::int) over (partition by user_id order by ts rows unbounded preceding) as k from o)
    select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts) + interval 6 hours) as "end", count(*) as n from n group by user_id, k""",
)
def stream_session(spark: S, d: str) -> DataFrame:
    return _ended(streams.run_to_end(streams.sessions(streams.event_stream(spark, d)), "docquarry_sessions"), streams.open_sessions(streams.event_table(spark, d)))


@register("stream_tumbling", """select epoch_us(date_trunc('day', ts)) as start, epoch_us(date_trunc('day', ts) + interval 1 day) as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def stream_tumbling(spark: S, d: str) -> DataFrame:
    got = _ended(streams.run_to_end(streams.windows(streams.event_stream(spark, d)), "docquarry_days"), streams.open_windows(streams.event_table(spark, d)))
    return got.withColumn("total", F.round("total", 4))


@register(
    "stream_sliding",
    """select epoch_us(s) as start, epoch_us(s + interval 12 hours) as "end", event_type, count(*) as n, round(sum(value), 4) as total
    from (select *, date_trunc('day', ts) + interval 6 hours * (date_part('hour', ts)::int // 6 - i) as s from events, range(2) as r(i)) group by all""",
)
def stream_sliding(spark: S, d: str) -> DataFrame:
    how = {"length": "12 hours", "slide": "6 hours"}
    got = _ended(streams.run_to_end(streams.windows(streams.event_stream(spark, d), **how), "docquarry_slides"), streams.open_windows(streams.event_table(spark, d), **how))
    return got.withColumn("total", F.round("total", 4))


@register("header_validation", f"with {_HEADERS_SQL} select doc_id, 4 as named, count(item)::bigint as real from documents left join (select doc_id, item from s where item <> '3') using (doc_id) group by doc_id")
def header_validation(spark: S, d: str) -> DataFrame:
    """How many item numbers a document names (in comments too), and how many of them head a section."""
    f = _filings(spark, d)
    real = op.audit_items(f).groupBy("doc_id").agg(F.sum("real").alias("real"))
    return f.select("doc_id", F.size(op.item_headers(F.col("html"))).alias("named")).join(real, "doc_id", "left").select("doc_id", "named", F.coalesce("real", F.lit(0)).alias("real"))


@register("entity_flex_find", f"with {_H} select doc_id, (strpos(h, 'Item&nbsp;1A') - 1)::int as start from h")
def entity_flex_find(spark: S, d: str) -> DataFrame:
    """Where a title stands, if its white space may be written as entities."""
    flex = op.entity_flexible("Item 1A")
    return _filings(spark, d).select("doc_id", F.when(F.rlike("html", F.lit(flex)), F.length(F.element_at(F.split("html", flex, 2), 1))).alias("start"))


@register(
    "stream_guard",
    """with e as (select user_id, event_id as seq, event_type = 'error' as failed, floor(value * 10) as cost from events), r as (select *, sum(case when failed then 0 else 1 end) over (partition by user_id order by seq) as run from e),
 s as (select *, case when failed then sum(failed::int) over (partition by user_id, run order by seq) else 0 end as streak from r), w as (select *, coalesce(sum(cost) over p, 0)::double as spent_before, coalesce(max((streak >= 3)::int) over p, 0) = 1 as open from s window p as (partition by user_id order by seq rows between unbounded preceding and 1 preceding))
 select user_id, seq, streak::bigint as streak, open, spent_before, spent_before <= 3000 as allowed from w""",
)
def stream_guard(spark: S, d: str) -> DataFrame:
    """Breaker and running cap of each user as a stream with state, read back from what it wrote."""
    at = f"{shared_dir(spark)}/guard-{uuid.uuid4().hex}"
    state.run_guarded(state.event_calls(streams.event_stream(spark, d)), "user_id", 3, 3000.0, f"{at}/out", f"{at}/mark")
    return spark.read.parquet(f"{at}/out").select("user_id", "seq", "streak", "open", "spent_before", "allowed")
