"""Grounding over records of the four workers, made from the documents, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from docquarry.operators import grounding as op
from docquarry.plans.common import table
from docquarry.plans.registry import register
from docquarry.session import materialize

S = SparkSession
#: Of each part with citations, in the order of its schema: how many it has in a document's record, as SQL over ``doc_id``.
COUNTS = {
    "ten_k": {"guidance_tone": "1", "accrual_flags": "doc_id % 3", "supplier_mentions": "doc_id % 2", "customer_mentions": "0", "risk_factor_deltas": "doc_id % 4", "going_concern": "(doc_id % 5 = 0)::int", "icfr_material_weaknesses": "doc_id % 2", "critical_accounting_estimate_changes": "1"},
    "eight_k": {"milestone_mentions": "doc_id % 4", "dilution_language_flags": "doc_id % 2"},
    "s_filing": {"dilution_event": "1", "capital_raise_language": "doc_id % 3", "use_of_proceeds": "doc_id % 5"},
    "transcript": {"prepared_remarks_tone": "1", "q_and_a_evasiveness": "1", "forward_statements": "doc_id % 6"},
}


def _record(worker: str) -> Column:
    """A record that cites ten characters from every seventh place on; every eleventh citation, counted over documents and places, is wrong."""
    slot = iter(range(100))

    def cite() -> Column:
        k = next(slot)
        quote = F.substring(F.coalesce("text", F.lit("")), 7 * k + 1, 10)
        wrong = (F.col("doc_id") + k) % 11 == 0
        return F.struct(F.struct(F.lit(7 * k).cast("bigint").alias("start"), F.lit(7 * k + 10).cast("bigint").alias("end")).alias("source_span"), F.when(wrong, F.concat(quote, F.lit("~"))).otherwise(quote).alias("source_quote"))

    def value(name: str, kind: DataType, top: bool) -> Column:
        if op.is_citation(kind):
            return cite()
        if top and name in COUNTS[worker]:
            n = F.expr(COUNTS[worker][name].replace("::int", "").replace("(doc_id % 5 = 0)", "if(doc_id % 5 = 0, 1, 0)"))
            if isinstance(kind, ArrayType):
                return F.slice(F.array(*(value(name, kind.elementType, False) for _ in range(6))), F.lit(1), n.cast("int"))
            return F.when(n > 0, value(name, kind, False))
        if isinstance(kind, StructType):
            return F.struct(*(value(f.name, f.dataType, False).alias(f.name) for f in kind.fields))
        if name in op.OPTIONAL:
            return F.lit(None).cast(kind)
        if name == "confidence":
            return F.lit("high")
        if isinstance(kind, ArrayType):
            return F.array().cast(kind)
        return F.lit("2024-01-01").cast("date") if name == "fiscal_period_end" else F.lit("x").cast(kind)

    return F.struct(*(value(f.name, f.dataType, True).alias(f.name) for f in op.RECORDS[worker].fields)).cast(op.RECORDS[worker])


def _slots_sql(worker: str) -> str:
    """(doc_id, slot, path, wrong, bare) of every citation of every record. An array has six places, of which its first ones are filled."""
    rows, k = [], 0
    for f in op.RECORDS[worker].fields:
        if f.name not in COUNTS[worker]:
            continue
        many = isinstance(f.dataType, ArrayType)
        for i in range(6 if many else 1):
            below = f.dataType.elementType if many else f.dataType
            tail = ".citation" if isinstance(below, StructType) and "citation" in below.names else ""
            rows.append(f"select doc_id, {k} as slot, '{f.name}{f'[{i}]' if many else ''}{tail}' as path, text from documents where {COUNTS[worker][f.name]} > {i}")
            k += 1
    return f"(select doc_id, slot, path, (doc_id + slot) % 11 = 0 as wrong, (doc_id + slot) % 11 <> 0 and length(coalesce(text, '')) <= 7 * slot as bare from ({' union all '.join(rows)}))"


def _summary_sql(worker: str) -> str:
    return f"""select doc_id, coalesce(n, 0)::int as n_citations, coalesce(f, 0)::int as n_failures, coalesce(b, 0)::int as n_problems, first_failure,
 case when coalesce(b, 0) > 0 then 'invalid' when coalesce(f, 0) > 0 then 'ungrounded' else 'ok' end as outcome from documents left join
 (select doc_id, count(*) as n, count(*) filter (where wrong) as f, count(*) filter (where bare) as b, arg_min(path, slot) filter (where wrong) as first_failure from {_slots_sql(worker)} group by doc_id) using (doc_id)"""


def _grounded(spark: S, d: str, worker: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return op.ground(docs.select("doc_id", _record(worker).alias("record")), docs, op.RECORDS[worker])


def _summary(worker: str) -> Callable[[S, str], DataFrame]:
    def run(spark: S, d: str) -> DataFrame:
        first = F.get("failures", F.lit(0))["path"].alias("first_failure")
        return _grounded(spark, d, worker).select("doc_id", "n_citations", F.size("failures").alias("n_failures"), F.size("problems").alias("n_problems"), first, "outcome")

    return run


for _worker in COUNTS:
    register(f"grounding_{_worker}", _summary_sql(_worker))(_summary(_worker))


@register("grounding_failures", " union all ".join(f"select doc_id, '{w}' as worker, path from {_slots_sql(w)} where wrong" for w in COUNTS))
def grounding_failures(spark: S, d: str) -> DataFrame:
    """Every failure of every record, by worker."""
    out = None
    for w in COUNTS:
        one = _grounded(spark, d, w).select("doc_id", F.lit(w).alias("worker"), F.explode("failures.path").alias("path"))
        out = one if out is None else out.unionByName(one)
    return out


@register("grounding_quarantine", " union all ".join(f"select '{w}' as worker, count(*) as n, count(*) filter (where b > 0) as by_schema from (select doc_id, count(*) filter (where bare) as b, count(*) filter (where wrong) as f from {_slots_sql(w)} group by doc_id) where b > 0 or f > 0" for w in COUNTS))
def grounding_quarantine(spark: S, d: str) -> DataFrame:
    """What is kept from each worker's sink, with the model's output as it was, written and read back."""
    out = None
    for w in COUNTS:
        kept = op.quarantined(_grounded(spark, d, w), w, "v1")
        out = kept if out is None else out.unionByName(kept)
    rows = materialize(out, "quarantine")
    return rows.groupBy("worker").agg(F.count("*").alias("n"), F.count_if(~F.startswith("error", F.lit("citation grounding"))).alias("by_schema"))
