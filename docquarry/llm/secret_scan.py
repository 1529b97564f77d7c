"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. A ledger holds, for each (blob, rule version), the spans
found; only pairs that it lacks are scanned, each distinct text once however many paths hold it, and findings are joined back to
all paths by blob address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of ``group`` (0: the whole match). Matches that fail are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: Kinds in their order, patterns, checked group, least length.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULE_VERSION = "base-1"
FOUND = "array<struct<start:int,kind_at:int,kind:string,stop:int>>"
LEDGER = f"blob string, rule_version string, found {FOUND}"


def _narrowed(r: Rule) -> str:
    """For a pattern that is one greedy character run, short runs can be passed over in the pattern itself: a run that fails holds no
    other match. Patterns with a checked group stay as they are, since a failing match takes up text."""
    if r.group == 0 and r.pattern.endswith("]+"):
        head = r.pattern[: r.pattern.index("[")]
        return f"{r.pattern[:-1]}{{{max(1, r.least - len(head))},}}"
    return r.pattern


def _spans(at: int, r: Rule, whole: Column, group: Column, pieces: Column) -> Column:
    """Spans in code points: piece i, match i, piece i + 1, ... make up the text, so starts are running sums of lengths."""
    rows = F.zip_with(F.slice(pieces, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), group.alias("g")), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m["w"]).alias("len"), F.length(m["g"]).alias("g")))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        hit = F.struct(start.alias("start"), F.lit(at).alias("kind_at"), F.lit(r.kind).alias("kind"), (start + x["len"]).alias("stop"))
        return F.struct((start + x["len"]).alias("at"), F.when(x["g"] >= r.least, F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))
    return F.aggregate(rows, zero, step, lambda s: s["out"])


def scan_texts(blobs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``found``: every span of every rule, by start, then kind as listed."""
    df = blobs
    for i, r in enumerate(rules):
        pat = F.lit(_narrowed(r))
        df = df.withColumn(f"__m{i}", F.regexp_extract_all(F.col(text), pat, F.lit(0)))
    empty = F.array().cast(FOUND)
    for i, r in enumerate(rules):
        m = F.col(f"__m{i}")
        group = F.regexp_extract_all(F.col(text), F.lit(_narrowed(r)), F.lit(r.group)) if r.group else m
        df = df.withColumn(f"__f{i}", F.when(F.size(m) > 0, _spans(i, r, m, group, F.split(F.col(text), _narrowed(r), -1))).otherwise(empty))
    every = F.concat(*[F.col(f"__f{i}") for i in range(len(rules))])
    return df.withColumn("found", F.array_sort(every)).drop(*[f"__{x}{i}" for i in range(len(rules)) for x in "mf"])


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def address(docs: DataFrame, text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """(blob, text) of each distinct text that ``ledger`` has no row of ``rule_version`` for. Copies meet map-side first."""
    own = docs.select(address(docs, text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        own = own.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return own.groupBy("blob").agg(F.first("text").alias("text"))


def scan_incremental(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, found) for what ``ledger`` lacks; append them to it."""
    return scan_texts(unseen_blobs(docs, ledger, rule_version, text), "text", rules).select("blob", F.lit(rule_version).alias("rule_version"), "found")


def findings(docs: DataFrame, ledger: DataFrame, path: str = "doc_id", rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """(path, blob, found) of every row of ``docs``: the ledger's findings joined back to all paths that hold the blob.

    Null text: the empty blob, no findings. Repeated rows stay repeated. Empty table: no rows. Other columns are not read.
    The join is by blob address; a blob that many paths share is split by the engine's skew handling, as nothing above regroups."""
    paths = docs.select(F.col(path).alias(path), address(docs, text).alias("blob"))
    return paths.join(ledger.where(F.col("rule_version") == rule_version).select("blob", "found"), "blob", "left")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """Counts, spans and their digest for every document, in SQL (document ids distinct)."""
    quoted = lambda r: "'" + _narrowed(r).replace("'", "''") + "'"
    kinds = " union all ".join(
        f"select doc_id, '{r.kind}' as kind, {i} as o, regexp_split_to_array(t, {quoted(r)}) as p, regexp_extract_all(t, {quoted(r)}, 0) as m, regexp_extract_all(t, {quoted(r)}, {r.group}) as g, {r.least} as least from t" for i, r in enumerate(rules)
    )
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in rules)
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents), k as ({kinds}),
i as (select *, unnest(range(1, len(m) + 1)) as i from k),
s as (select doc_id, kind, o, i, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as start, length(m[i]) as n, length(g[i]) as held, least from i),
f as (select *, kind || ':' || start || ':' || (start + n) as span from s where held >= least)
select doc_id, {counts}, sha256(coalesce(string_agg(span, ',' order by start, o), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, o), '') as spans from documents left join f using (doc_id) group by doc_id"""
