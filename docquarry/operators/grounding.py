"""Grounding of nested records: every citation that a schema can reach, in the order of the schema, against its source text.

The walk is over the schema, once, on the driver: it yields column expressions that reach the citations of any record of that schema, through
structs, arrays and parts that may be missing, with the path of each. Records are then walked where they are, without Python. Branches that
hold no citation cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from docquarry.operators.citations import resolve_quotes



def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S = StringType()
_CITATION = _struct(source_span=_struct(start=LongType(), end=LongType()), source_quote=_S)
_CLAIM = _struct(citation=_CITATION, confidence=_S)
_MENTION = _struct(mention_text=_S, citation=_CITATION, resolved_ticker=_S, resolver_confidence=DoubleType(), resolver_reasoning=_S)
_DELTA = _struct(change_type=_S, text=_S, citation=_CITATION)
_STATEMENT = _struct(statement_text=_S, citation=_CITATION, mentioned_entities=ArrayType(_S), horizon=_S)
#: The records of the four workers.
RECORDS = {
    "ten_k": _struct(
        cik=_S, accession_number=_S, fiscal_period_end=DateType(), guidance_tone=_CLAIM, accrual_flags=ArrayType(_CLAIM), supplier_mentions=ArrayType(_MENTION), customer_mentions=ArrayType(_MENTION),
        language_novelty_score=DoubleType(), risk_factor_deltas=ArrayType(_DELTA), going_concern=_CLAIM, icfr_material_weaknesses=ArrayType(_CLAIM), critical_accounting_estimate_changes=ArrayType(_CLAIM),
    ),
    "eight_k": _struct(cik=_S, accession_number=_S, event_classification=_S, milestone_mentions=ArrayType(_CLAIM), dilution_language_flags=ArrayType(_CLAIM)),
    "s_filing": _struct(cik=_S, accession_number=_S, form_type=_S, dilution_event=_CLAIM, capital_raise_language=ArrayType(_CLAIM), use_of_proceeds=ArrayType(_CLAIM)),
    "transcript": _struct(ticker=_S, event_datetime=TimestampType(), prepared_remarks_tone=_CLAIM, q_and_a_evasiveness=_CLAIM, forward_statements=ArrayType(_STATEMENT)),
}
#: Parts of the records that may be missing; what a confidence may be.
OPTIONAL = frozenset("resolved_ticker resolver_confidence resolver_reasoning going_concern event_datetime language_novelty_score".split())
CONFIDENCE = ("high", "medium", "low")
FOUND = "array<struct<path:string,start:bigint,stop:bigint,quote:string>>"
PROBLEMS = "array<struct<path:string,problem:string>>"


def is_citation(kind: DataType) -> bool:
    return isinstance(kind, StructType) and {"source_span", "source_quote"} <= set(kind.names)


def _walk(value: Column, kind: DataType, path: Column, leaf: Callable[[Column, DataType, Column, str], Column | None], out: str, name: str = "") -> Column | None:
    """Concatenated ``leaf`` results (arrays of type ``out``) over everything that ``kind`` reaches, depth first, in the order of its fields and
    of arrays; null where nothing below has any. ``leaf`` may decide on a part before what is in it."""
    none = F.array().cast(out)
    parts = [x for x in [leaf(value, kind, path, name)] if x is not None]
    if isinstance(kind, StructType) and not is_citation(kind):
        for f in kind.fields:
            below = _walk(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), leaf, out, f.name)
            parts += [below] if below is not None else []
    elif isinstance(kind, ArrayType):
        holds = _walk(value, kind.elementType, path, leaf, out, name)
        if holds is not None:
            each = lambda x, i: _walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), leaf, out, name)
            parts.append(F.coalesce(F.flatten(F.transform(value, each)), none))
    return F.concat(*parts) if parts else None


def _trimmed(found: Column) -> Column:
    """Paths without the dot that the walk begins with."""
    return F.transform(found, lambda x: x.withField("path", F.ltrim(x["path"], F.lit("."))))


def citations_of(record: Column, kind: StructType) -> Column:
    """Array of (path, start, stop, quote) of every citation of a record, in traversal order; empty for a record without any."""

    def leaf(value: Column, k: DataType, path: Column, _: str) -> Column | None:
        if not is_citation(k):
            return None
        span = value["source_span"]
        one = F.struct(path.alias("path"), span["start"].alias("start"), span["end"].alias("stop"), value["source_quote"].alias("quote"))
        return F.when(value.isNotNull(), F.array(one)).otherwise(F.array()).cast(FOUND)

    got = _walk(record, kind, F.lit(""), leaf, FOUND)
    return F.array().cast(FOUND) if got is None else _trimmed(F.coalesce(got, F.array().cast(FOUND)))


def problems_of(record: Column, kind: StructType) -> Column:
    """Array of (path, problem) of what a record's schema forbids, in traversal order: ``missing`` parts that aren't optional, ``empty_quote``,
    ``bad_span`` (without 0 <= start < end), ``bad_confidence``. A null record has the one problem ``missing``."""

    def leaf(value: Column, k: DataType, path: Column, name: str) -> Column | None:
        tests: list[tuple[Column, str]] = []
        if name and name not in OPTIONAL:
            tests.append((value.isNull(), "missing"))
        if is_citation(k):
            start, end = value["source_span"]["start"], value["source_span"]["end"]
            tests.append((value.isNotNull() & (F.coalesce(value["source_quote"], F.lit("")) == ""), "empty_quote"))
            tests.append((value.isNotNull() & ~F.coalesce((start >= 0) & (start < end), F.lit(False)), "bad_span"))
        if name == "confidence" and isinstance(k, StringType):
            tests.append((value.isNotNull() & ~value.isin(*CONFIDENCE), "bad_confidence"))
        if not tests:
            return None
        found = F.filter(F.array(*[F.when(bad, F.struct(path.alias("path"), F.lit(p).alias("problem"))) for bad, p in tests]), lambda x: x.isNotNull())
        return found.cast(PROBLEMS)

    got = _within(record, kind, F.lit(""), leaf, PROBLEMS)  # parts of a missing part aren't problems of their own
    whole = F.array(F.struct(F.lit("").alias("path"), F.lit("missing").alias("problem"))).cast(PROBLEMS)
    return _trimmed(F.when(record.isNull(), whole).otherwise(got))


def _within(value: Column, kind: DataType, path: Column, leaf: Callable[[Column, DataType, Column, str], Column | None], out: str, name: str = "") -> Column:
    """``_walk`` that doesn't go into missing parts."""
    none = F.array().cast(out)
    own = leaf(value, kind, path, name)
    parts = [own] if own is not None else []
    if isinstance(kind, StructType) and not is_citation(kind):
        below = [_within(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), leaf, out, f.name) for f in kind.fields]
        parts.append(F.when(value.isNotNull(), F.concat(*below)).otherwise(none))
    elif isinstance(kind, ArrayType):
        each = lambda x, i: _within(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), leaf, out, name or "item")
        parts.append(F.coalesce(F.flatten(F.transform(value, each)), none))
    return F.concat(*parts) if parts else none


def slice_of(text: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` up to ``stop``: fewer where the text ends before; none without a text."""
    return F.coalesce(F.substring(text, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int")), F.lit(""))


def failures(text: Column, found: Column) -> Column:
    """Those of ``citations_of`` whose span of ``text`` isn't their quote, with their ordinal and what the span holds."""
    numbered = F.transform(found, lambda c, i: F.struct(i.alias("ordinal"), *(c[k].alias(k) for k in ("path", "start", "stop", "quote")), slice_of(text, c["start"], c["stop"]).alias("actual")))
    return F.filter(numbered, lambda c: ~c["quote"].eqNullSafe(c["actual"]))


def ground(records: DataFrame, docs: DataFrame, kind: StructType, key: str = "doc_id", record: str = "record", text: str = "text") -> DataFrame:
    """(key, record, n_citations, problems, failures, outcome, error) of every record: ``invalid`` if its schema forbids it, else ``ungrounded``
    if a citation fails, else ``ok``; ``error`` names the first problem or failure. A record without a document fails by its citations."""
    both = records.select(key, record).join(docs.select(key, text), key, "left")
    found = both.withColumn("__found", citations_of(F.col(record), kind)).withColumn("problems", problems_of(F.col(record), kind))
    checked = found.withColumn("failures", failures(F.col(text), F.col("__found")))
    p, f = F.get("problems", F.lit(0)), F.get("failures", F.lit(0))
    outcome = F.when(F.size("problems") > 0, "invalid").when(F.size("failures") > 0, "ungrounded").otherwise("ok")
    said = F.format_string("citation grounding failed at %s: span=(%s,%s) expected='%s' actual='%s'", f["path"], f["start"].cast("string"), f["stop"].cast("string"), f["quote"], f["actual"])
    error = F.when(F.size("problems") > 0, F.concat_ws(": ", p["path"], p["problem"])).when(F.size("failures") > 0, said)
    return checked.select(key, record, F.size("__found").alias("n_citations"), "problems", "failures", outcome.alias("outcome"), error.alias("error"))


def quarantined(grounded: DataFrame, worker: str, prompt_version: str, key: str = "doc_id", record: str = "record") -> DataFrame:
    """(key, worker, prompt_version, output, error) of the records that aren't ``ok``: what the model gave, whole, and why it isn't kept."""
    return grounded.where("outcome <> 'ok'").select(key, F.lit(worker).alias("worker"), F.lit(prompt_version).alias("prompt_version"), F.to_json(record).alias("output"), "error")


def with_spans(records: DataFrame, docs: DataFrame, kind: StructType, key: str = "doc_id", record: str = "record", text: str = "text") -> DataFrame:
    """``records`` with the spans of their quotes as the text has them, and an ``unresolved`` array of (path, outcome).

    Quotes of a record are resolved in traversal order, white space standing for any: the n-th citation of a quote takes its n-th occurrence
    if both are as many, and the text's own spelling; others keep their quote and lose their span. Keys are distinct."""
    claims = records.select(F.col(key).alias("doc_id"), F.posexplode(citations_of(F.col(record), kind)).alias("ordinal", "c")).select("doc_id", "ordinal", "c.path", "c.quote")
    got = resolve_quotes(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), claims.select("doc_id", "ordinal", "quote"))
    named = got.join(claims.select("doc_id", "ordinal", "path"), ["doc_id", "ordinal"])
    ok = F.col("outcome") == "ok"
    good = F.map_from_entries(F.collect_list(F.when(ok, F.struct("path", F.struct("start", "stop", "snapped").alias("v")))))
    bad = F.array_sort(F.collect_list(F.when(~ok, F.struct("ordinal", "path", "outcome"))))
    per = named.groupBy(F.col("doc_id").alias(key)).agg(good.alias("__spans"), bad.alias("__bad"))
    both = records.join(per, key, "left")

    def rewritten(value: Column, k: DataType, path: Column) -> Column:
        if is_citation(k):
            hit = F.try_element_at(F.col("__spans"), F.ltrim(path, F.lit(".")))
            span = F.when(hit.isNotNull(), F.struct(hit["start"].cast("bigint").alias("start"), hit["stop"].cast("bigint").alias("end")))
            return F.when(value.isNotNull(), F.struct(span.alias("source_span"), F.coalesce(hit["snapped"], value["source_quote"]).alias("source_quote")))
        if isinstance(k, StructType):
            return F.when(value.isNotNull(), F.struct(*(rewritten(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name))).alias(f.name) for f in k.fields)))
        if isinstance(k, ArrayType) and _walk(value, k.elementType, path, lambda v, t, *_: F.array() if is_citation(t) else None, "array<string>") is not None:
            return F.transform(value, lambda x, i: rewritten(x, k.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return value

    none = F.array().cast("array<struct<path:string,outcome:string>>")
    unresolved = F.coalesce(F.transform("__bad", lambda b: F.struct(b["path"].alias("path"), b["outcome"].alias("outcome"))), none)
    return both.withColumn(record, rewritten(F.col(record), kind, F.lit("")).cast(kind)).withColumn("unresolved", unresolved).drop("__spans", "__bad")
