"""Small parsers and shapers (names, times, headers, nested JSON), over values made from the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import keys, outcomes, text
from docquarry.operators import citations, ledger, readers
from docquarry.operators import retrieval
from docquarry.plans.common import table
from docquarry.plans.registry import register
from docquarry.session import shared_dir, ship_package
from docquarry.sources import files, landed

S = SparkSession


def _pick(n: Column, *choices: Column | str) -> Column:
    """One of ``choices`` by ``n`` modulo their number."""
    out = F.lit(None).cast("string")
    for k, c in reversed(list(enumerate(choices))):
        out = F.when(n % len(choices) == k, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


def _pick_sql(n: str, *choices: str) -> str:
    return f"case {n} % {len(choices)} " + " ".join(f"when {k} then {c}" for k, c in enumerate(choices)) + " end"


_ENDS = {"/call.MP3?x=1#t": ".mp3", "/call.m4a;v=1": ".m4a", "/": ".bin", "/readme": ".bin", "/v1.2/noext": ".bin"}


@register("url_ext", f"select page_id, {_pick_sql('page_id', *(repr(x) for x in _ENDS.values()))} as ext from pages")
def url_ext(spark: S, d: str) -> DataFrame:
    """Extensions of files below each page's host."""
    host = F.regexp_extract("url", "^([a-z]+://[^/]*)", 1)
    return table(spark, d, "pages").select("page_id", text.url_extension(F.concat(host, _pick(F.col("page_id"), *_ENDS))).alias("ext"))


_HEADS = {"494433040000": "true", "4F67675300": "true", "00000020667479704D34": "true", "FFFB9000": "true", "3C21444F43": "false", "FF": "false"}


@register("magic_bytes", f"select doc_id, {_pick_sql('doc_id', *_HEADS.values())} as audio from documents")
def magic_bytes(spark: S, d: str) -> DataFrame:
    """Files that begin like audio, or not, and go on with a document's text."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    head = F.unhex(_pick(F.col("doc_id"), *_HEADS))
    return docs.select("doc_id", text.looks_like_audio(F.concat(head, F.unhex(F.lit("00")), F.col("text").cast("binary"))).alias("audio"))


@register("json_guard", f"select event_id, {_pick_sql('event_id', repr('object'), repr('not_object'), repr('malformed'), repr('missing'))} as outcome from events")
def json_guard(spark: S, d: str) -> DataFrame:
    """An event's properties as they are, in an array, cut short, and absent."""
    j = F.to_json(F.struct("user_id", "event_type"))
    broken = _pick(F.col("event_id"), j, F.concat(F.lit("["), j, F.lit("]")), F.substring(j, 1, 9), F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", outcomes.json_outcome(broken).alias("outcome"))


@register("schema_validate", f"select event_id, {_pick_sql('event_id', repr('ok'), repr('unknown_key'), repr('bad_type'), repr('missing_key'), repr('malformed'))} as outcome from events")
def schema_validate(spark: S, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    made = _pick(F.col("event_id"), F.concat(F.lit('{"a":'), user, F.lit("}")), F.concat(F.lit('{"a":'), user, F.lit(',"zz":2}')), F.concat(F.lit('{"a":"u'), user, F.lit('"}')), F.lit("{}"), F.concat(F.lit('{"a":'), user))
    return table(spark, d, "events").select("event_id", citations.strict_outcome(made, {"a": "int"}).alias("outcome"))


@register("parse_acceptance", "select event_id, epoch(date_trunc('second', ts))::bigint + case event_id % 3 when 0 then 0 when 1 then -5 * 3600 else 5 * 3600 end as epoch from events")
def parse_acceptance(spark: S, d: str) -> DataFrame:
    """Times with Z, with an offset five hours ahead, and naive ones, which are New York's (the events are in winter)."""
    at = lambda tail: F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    raw = _pick(F.col("event_id"), at(".000Z"), at("+05:00"), at(""))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(outcomes.acceptance_time(raw)).alias("epoch"))


@register("retry_after", "select event_id, case event_id % 4 when 0 then least(user_id * 10, 300) when 1 then 0 when 2 then least(user_id % 50, 300) end::double as seconds from events")
def retry_after(spark: S, d: str) -> DataFrame:
    """Seconds, negative ones, HTTP dates and words."""
    now = F.lit("2015-10-21 07:27:00").cast("timestamp")
    date = F.concat(F.lit("Wed, "), F.date_format(F.timestamp_add("SECOND", (F.col("user_id") % 50).cast("int"), now), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    raw = _pick(F.col("event_id"), (F.col("user_id") * 10).cast("string"), (-F.col("user_id") - 1).cast("string"), date, "soon")
    return table(spark, d, "events").select("event_id", outcomes.retry_after(raw, now).alias("seconds"))


@register("version_name", "select p_partkey, case when p_partkey % 3 = 0 then p_brand else p_name end as base, case when p_partkey % 3 = 0 then 'v' || p_size end as version from part")
def version_name(spark: S, d: str) -> DataFrame:
    """Table names with and without a version."""
    n = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("__", "p_brand", F.concat(F.lit("v"), "p_size"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", keys.split_table_name(n).alias("x")).select("p_partkey", "x.*")


@register("gc_retention", "select version, row_number() over (order by version = 'v2' desc, position desc) <= 3 as keep from (select 'v' || (o_custkey % 20) as version, max(o_orderkey) as position from orders group by 1)")
def gc_retention(spark: S, d: str) -> DataFrame:
    """Orders as a log of promotions: which of the twenty versions stay."""
    history = table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("v"), F.col("o_custkey") % 20).alias("version"))
    return ledger.retained(history, "v2", 3)


@register("date_checks", "select o_orderkey, case when o_orderkey % 3 < 2 then year(o_orderdate) end::int as year, case when o_orderkey % 3 = 0 then quarter(o_orderdate) end::int as quarter, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def date_checks(spark: S, d: str) -> DataFrame:
    """Names that end in a year and quarter, in a year, in neither; dates in ISO form."""
    year, quarter = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    name = _pick(F.col("o_orderkey"), F.concat(F.lit("filing_"), year, F.lit("_q"), quarter), F.concat(F.lit("filing_"), year), F.concat(F.lit("filing"), year))
    p = readers.trailing_period(F.col("name"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", name.alias("name"))
    return rows.select("o_orderkey", p["year"].alias("year"), p["quarter"].alias("quarter"), readers.iso_date(F.col("o_orderdate")).alias("day"))


@register("transcript_constraints", f"select doc_id, {_pick_sql('doc_id', repr(''), repr('ticker,quarter,event_datetime,prepared_remarks'), repr('ticker,year,quarter,q_and_a'), repr('year'))} as problems from documents")
def transcript_constraints(spark: S, d: str) -> DataFrame:
    """Calls made of documents: sound ones, and three ways of being wrong."""
    docs, k = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), F.col("doc_id")
    number = lambda *c: _pick(k, *c).cast("int")
    ticker, year, quarter = _pick(k, "ABC.B", "abc", "ABCDEFGHI", "XYZ"), number("2024", "2024", "1899", "2101"), number("1", "5", "0", "4")
    at = _pick(k, "2024-01-02T10:00:00Z", "2024-01-02T10:00:00", "2024-01-02T10:00:00+05:00", "2024-01-02T10:00:00Z")
    prepared, answers = F.when(k % 4 != 1, F.col("text")), F.when(k % 4 != 2, F.lit(""))
    return docs.select("doc_id", F.array_join(readers.transcript_problems(ticker, year, quarter, at, prepared, answers), ",").alias("problems"))


@register("flatten_aliases", "select * from (select p_partkey, 0 as pos, p_name as alias, p_name as first_alias from part union all select p_partkey, 2, p_brand, p_name from part) where trim(alias) <> ''")
def flatten_aliases(spark: S, d: str) -> DataFrame:
    """A part's name, a blank and its brand as aliases: blanks go, the first stays the primary one."""
    u = table(spark, d, "part").select("p_partkey", F.array("p_name", F.lit(" "), "p_brand").alias("aliases"))
    flat = u.select("p_partkey", F.element_at("aliases", 1).alias("first_alias"), F.posexplode("aliases").alias("pos", "alias"))
    return flat.where(F.trim("alias") != "").select("p_partkey", "pos", "alias", "first_alias")


@register("normalize_pick", "select c_custkey, case when c_custkey % 5 in (0, 4) then upper(n_name) end as ticker, case when c_custkey % 5 in (0, 4) then 'resolved' when c_custkey % 5 in (1, 2) then 'unknown' else 'off_list' end as outcome from customer join nation on n_nationkey = c_nationkey")
def normalize_pick(spark: S, d: str) -> DataFrame:
    """Customers pick their nation in other letters and with blanks, nothing, something null-like, or what isn't on the slate."""
    nation = table(spark, d, "nation")
    slate = nation.select(F.upper("n_name").alias("ticker"), F.lit(True).alias("listed"))
    own = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    pick = _pick(F.col("c_custkey"), F.concat(F.lit("  "), F.lower("n_name")), F.lit(None).cast("string"), " n/a ", F.concat(F.lit("X"), "n_name"), F.col("n_name"))
    return retrieval.normalize_picks(own.select("c_custkey", pick.alias("pick")), slate).select("c_custkey", "ticker", "outcome")


@register("map_values_unnest", "select c_mktsegment as ticker, lpad(c_custkey::varchar, 10, '0') as cik from customer")
def map_values_unnest(spark: S, d: str) -> DataFrame:
    """Customers as one JSON map a nation, and back to rows."""
    entry = F.struct(F.col("c_custkey").cast("string").alias("k"), F.struct(F.col("c_mktsegment").alias("ticker"), F.col("c_custkey").alias("cik")).alias("v"))
    maps = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("j"))
    got = maps.select(F.explode(F.map_values(F.from_json("j", "map<string,struct<ticker:string,cik:long>>"))).alias("v"))
    return got.select("v.ticker", keys.pad_cik(F.col("v.cik")).alias("cik"))


@register("xbrl_flatten", "select l_orderkey as cik, l_returnflag as tag, l_linestatus as unit, strftime(l_shipdate, '%Y-%m-%d') as period_end, l_extendedprice as value from lineitem")
def xbrl_flatten(spark: S, d: str) -> DataFrame:
    """An order's lines as nested facts (tag, unit, observations), and back to rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"), F.col("l_extendedprice").alias("val")).alias("o"))
    units = li.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list("o").alias("os")).groupBy("l_orderkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "os"))).alias("units"))
    facts = units.groupBy(F.col("l_orderkey").alias("cik")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "units")))).alias("j"))
    return files.flatten_facts(facts)


@register("exhibit_listing", "select l_orderkey as accession, 'ex' || l_linenumber || case when l_linenumber % 2 = 0 then '.HTM' else '.html' end as name, case when l_linenumber % 4 = 1 then 0 else l_partkey end as size from lineitem where l_linenumber % 3 <> 0")
def exhibit_listing(spark: S, d: str) -> DataFrame:
    """An order's lines as a filing's directory: markup files with and without a size, and images."""
    n = F.col("l_linenumber")
    name = F.concat(F.lit("ex"), n, F.when(n % 3 == 0, ".jpg").when(n % 2 == 0, ".HTM").otherwise(".html"))
    item = F.struct(name.alias("name"), F.when(n % 4 == 1, "").otherwise(F.col("l_partkey").cast("string")).alias("size"))
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.collect_list(item).alias("item"))
    return files.exhibits(pages.select("accession", F.to_json(F.struct(F.struct("item").alias("directory"))).alias("j")))


_FORMS = ("10-K", "8-K", "10-Q")


def land_listings(spark: S, d: str, folder: str) -> None:
    """Orders as landed listings: a file an entity (twenty of them) and month, in which some documents are blank."""
    o = table(spark, d, "orders").withColumn("entity", F.concat(F.lit("e"), F.col("o_custkey") % 20)).withColumn("day", F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd"))
    one = F.array_sort(F.collect_list(F.struct("o_orderkey", _pick(F.col("o_orderkey"), *_FORMS).alias("form"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat("o_orderkey", F.lit(".htm"))).alias("doc"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))))
    rows = o.groupBy("entity", "day").agg(one.alias("x"))
    recent = F.struct(F.col("x.form").alias("form"), F.col("x.o_orderkey").cast("array<string>").alias("accessionNumber"), F.col("x.doc").alias("primaryDocument"), F.col("x.at").alias("acceptanceDateTime"))
    lines = rows.select("day", F.to_json(F.struct("entity", F.struct(recent.alias("recent")).alias("filings"))).alias("value"))
    lines.repartition("day").write.partitionBy("day").text(folder)


@register("landed_listings", f"select 'e' || (o_custkey % 20) as entity, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as day, {_pick_sql('o_orderkey', *(repr(f) for f in _FORMS))} as form, o_orderkey::varchar as accession from orders where o_orderkey % 10 <> 0 and o_orderkey % 3 = 1 and o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1999-01-01'")
def landed_listings(spark: S, d: str) -> DataFrame:
    """Listings landed as files and read through their data source, with the days and the form pushed into it."""
    folder = f"{shared_dir(spark)}/listings-{uuid.uuid4().hex}"
    land_listings(spark, d, folder)
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(landed.ListingSource)
    got = spark.read.format("landed_listings").load(folder)
    return got.where("day >= '1997-03-01' and day < '1999-01-01' and form = '8-K'").select("entity", "day", "form", "accession")
