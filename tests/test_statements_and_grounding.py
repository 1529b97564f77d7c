"""Statement views against plain loops, what was known when, and grounding of nested records."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from docquarry.operators import grounding, statements

FACT = "cik long, kind string, concept string, period_end date, qtrs int, v double, accepted timestamp_ntz, accn long, line int"
ENDS = {1: (3, 31), 2: (6, 30), 3: (9, 30), 4: (12, 31)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for k in range(900):
        y, q = rng.choice([2020, 2021]), rng.randint(1, 4)
        kind = rng.choice(["income", "balance"])
        qtrs = 0 if kind == "balance" else rng.choice([1, q, q])
        out.append((rng.choice([1, 1, 1, 2]), kind, rng.choice(["a", "b"]), dt.date(y, *ENDS[q]), qtrs, float(rng.randint(1, 500)), dt.datetime(2022, 1, 1) + dt.timedelta(days=rng.randint(0, 40)), rng.randint(1, 60), rng.randint(1, 3)))
    return out


def picked(rows, last):
    out = {}
    for *key, v, accepted, accn, line in rows:
        out.setdefault(tuple(key), []).append((accepted, accn, line, v))
    return {k: (max if last else min)(x) for k, x in out.items()}


def plain_view(rows, kind, last, annual):
    one = picked([r for r in rows if r[1] == kind], last)
    out = {}
    for cik, concept, year in {(k[0], k[2], k[3].year) for k in one}:
        of = lambda q, n: one.get((cik, kind, concept, dt.date(year, *ENDS[q]), n))  # noqa: B023, E731
        for q in range(1, 5):
            if kind == "balance":
                got = of(q, 0) if not annual or q == 4 else None
                got = got and (got[3], got[0])
            elif annual:
                got = of(4, 4) if q == 4 else None
                got = got and (got[3], got[0])
            else:
                own, now, was = of(q, 1), of(q, q), of(q - 1, q - 1) if q > 1 else None
                got = (own[3], own[0]) if own else (now[3] - was[3], max(now[0], was[0])) if now and was and q > 1 else None
            if got:
                out.setdefault((cik, dt.date(year, *ENDS[q])), {})[concept] = got
    return {(*k, c.get("a", (None,))[0], c.get("b", (None,))[0], min(x[1] for x in c.values()), max(x[1] for x in c.values())) for k, c in out.items()}


@pytest.mark.parametrize("kind", ["income", "balance"])
@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("annual", [False, True])
def test_views(spark, rows, kind, last, annual):
    df = spark.createDataFrame(rows, FACT).repartition(3)
    got = statements.view(df, kind, ["a", "b"], last, annual)
    assert {tuple(r) for r in got.collect()} == plain_view(rows, kind, last, annual)


def test_what_was_known_when(spark, rows):
    """First reports never change with what came later; a read as known at a date is that of a table frozen then, and of the intervals."""
    df = spark.createDataFrame(rows, FACT)
    first = {tuple(r) for r in statements.reported(df).collect()}
    spans = statements.intervals(df)
    for day in (0, 7, 20, 39):
        at = dt.datetime(2022, 1, 1) + dt.timedelta(days=day)
        frozen = [r for r in rows if r[6] <= at]
        then = spark.createDataFrame(frozen, FACT)
        assert {tuple(r) for r in statements.reported(then).collect()} == {r for r in first if r[6] <= at}
        known = {tuple(r) for r in statements.known_at(df, F.lit(at)).select(*statements.FACT, "v").collect()}
        assert known == {(*k, x[3]) for k, x in picked(frozen, True).items()}
        held = spans.where((F.col("known_from") <= F.lit(at)) & (F.col("known_to").isNull() | (F.lit(at) < F.col("known_to"))))
        assert {tuple(r) for r in held.select(*statements.FACT, "v").collect()} == known
    assert spans.where("known_to <= known_from").count() == 0


def test_rolling_years_need_four_quarters(spark):
    at = dt.datetime(2022, 1, 1)
    ends = [dt.date(2020, *ENDS[q]) for q in (1, 2, 3, 4)] + [dt.date(2021, *ENDS[q]) for q in (1, 3, 4)]
    df = spark.createDataFrame([(1, "income", "a", e, float(k), at + dt.timedelta(days=k)) for k, e in enumerate(ends)], "cik long, kind string, concept string, period_end date, v double, accepted timestamp_ntz")
    got = {(r["period_end"], r["v"], r["accepted"].day) for r in statements.rolling_year(df).collect()}
    assert got == {(ends[3], 6.0, 4), (ends[4], 10.0, 5)}
    assert statements.rolling_year(df.where("cik < 0")).count() == 0 and statements.view(spark.createDataFrame([], FACT), "income", ["a"], False, False).count() == 0


# --- grounding ----------------------------------------------------------------------------------------------------------------------
TEXT = "Revenue rose by ten  percent. Costs fell. Costs fell again in é😀 markets."


def walk(value, path=""):
    """The same walk over parsed JSON."""
    if isinstance(value, dict) and "source_quote" in value:
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def cite(start, end, quote):
    return {"source_span": {"start": start, "end": end}, "source_quote": quote}


def claim(start, end, quote=None, confidence="high"):
    return {"citation": cite(start, end, TEXT[start:end] if quote is None else quote), "confidence": confidence}


def mention(start, end, quote=None):
    return {"mention_text": "m", "citation": cite(start, end, TEXT[start:end] if quote is None else quote), "resolved_ticker": None, "resolver_confidence": None, "resolver_reasoning": None}


def ten_k(**change):
    base = {
        "cik": "1", "accession_number": "a", "fiscal_period_end": "2024-01-01", "guidance_tone": claim(0, 7), "accrual_flags": [claim(8, 12), claim(60, 68)], "supplier_mentions": [mention(0, 4)], "customer_mentions": [],
        "language_novelty_score": 0.0, "risk_factor_deltas": [{"change_type": "new", "text": "t", "citation": cite(30, 35, TEXT[30:35])}], "going_concern": None, "icfr_material_weaknesses": [], "critical_accounting_estimate_changes": [],
    }
    return base | change


CASES = {
    1: (ten_k(), "ok", None, []),
    2: (ten_k(guidance_tone=claim(0, 7, "Revenu")), "ungrounded", "guidance_tone.citation", ["guidance_tone.citation"]),
    3: (ten_k(accrual_flags=[claim(8, 12), claim(60, 68, "x")], supplier_mentions=[mention(1, 5, "Reve")]), "ungrounded", "accrual_flags[1].citation", ["accrual_flags[1].citation", "supplier_mentions[0].citation"]),
    4: (ten_k(going_concern=claim(70, 900)), "ok", None, []),  # a span beyond the end holds what is there
    5: (ten_k(guidance_tone=None), "invalid", None, []),
    6: (ten_k(accrual_flags=[claim(8, 12, confidence="sure")]), "invalid", None, []),
    7: (ten_k(accrual_flags=[claim(12, 8, "")]), "invalid", None, []),
    8: (ten_k(risk_factor_deltas=[{"change_type": None, "text": "t", "citation": cite(30, 35, TEXT[30:35])}]), "invalid", None, []),
    9: (ten_k(icfr_material_weaknesses=None), "invalid", None, []),
}
PROBLEMS = {5: [("guidance_tone", "missing")], 6: [("accrual_flags[0].confidence", "bad_confidence")], 7: [("accrual_flags[0].citation", "empty_quote"), ("accrual_flags[0].citation", "bad_span")], 8: [("risk_factor_deltas[0].change_type", "missing")], 9: [("icfr_material_weaknesses", "missing")]}


@pytest.fixture(scope="module")
def filed(spark):
    kind = grounding.RECORDS["ten_k"]
    df = spark.createDataFrame([(k, json.dumps(v[0])) for k, v in CASES.items()], "doc_id long, j string").select("doc_id", F.from_json("j", kind).alias("record"))
    docs = spark.createDataFrame([(k, TEXT) for k in CASES if k != 1] + [(1, TEXT)], "doc_id long, text string")
    return kind, df, docs


def test_grounding_of_nested_records(spark, filed):
    kind, df, docs = filed
    got = {r["doc_id"]: r for r in grounding.ground(df, docs, kind).collect()}
    for k, (record, outcome, first, failing) in CASES.items():
        r = got[k]
        assert r["outcome"] == outcome and [f["path"] for f in r["failures"]][: len(failing)] == failing
        assert r["n_citations"] == sum(1 for _ in walk(record)) and [tuple(p) for p in r["problems"]] == PROBLEMS.get(k, [])
        assert (first is None) or r["error"].startswith(f"citation grounding failed at {first}: span=(")
    found = df.select("doc_id", grounding.citations_of(F.col("record"), kind).alias("c")).collect()
    for r in found:
        assert [(c["path"], c["start"], c["stop"], c["quote"]) for c in r["c"]] == [(p, c["source_span"]["start"], c["source_span"]["end"], c["source_quote"]) for p, c in walk(CASES[r["doc_id"]][0])]
    kept = {r["doc_id"]: r for r in grounding.quarantined(grounding.ground(df, docs, kind), "ten_k", "v1").collect()}
    assert set(kept) == set(CASES) - {1, 4} and json.loads(kept[2]["output"])["guidance_tone"]["citation"]["source_quote"] == "Revenu"


def test_grounding_without_documents_or_records(spark, filed):
    kind, df, docs = filed
    lone = grounding.ground(df.where("doc_id = 1"), docs.where("doc_id < 0"), kind).first()
    assert lone["outcome"] == "ungrounded" and lone["failures"][0]["actual"] == "" and len(lone["failures"]) == lone["n_citations"]
    null = spark.createDataFrame([(1, None)], f"doc_id long, record {kind.simpleString()}")
    r = grounding.ground(null, docs, kind).first()
    assert (r["outcome"], r["n_citations"], r["error"]) == ("invalid", 0, ": missing")
    assert grounding.ground(df.where("doc_id < 0"), docs, kind).count() == 0
    plain = _parse_datatype_string("struct<a:string,b:array<int>>")
    assert spark.createDataFrame([(("x", [1]),)], f"r {plain.simpleString()}").select(grounding.citations_of(F.col("r"), plain)).first()[0] == []


def test_spans_are_found_for_quotes(spark, filed):
    kind, _, docs = filed
    bare = lambda q: {"citation": {"source_quote": q}, "confidence": "low"}
    record = ten_k(guidance_tone=bare("rose by ten percent"), accrual_flags=[bare("Costs fell"), bare("Costs fell")], supplier_mentions=[], risk_factor_deltas=[{"change_type": "new", "text": "t", "citation": {"source_quote": "nowhere at all"}}], going_concern=bare("fell"))
    df = spark.createDataFrame([(1, json.dumps(record))], "doc_id long, j string").select("doc_id", F.from_json("j", kind).alias("record"))
    got = grounding.with_spans(df, docs, kind)
    assert got.schema["record"].dataType.simpleString() == kind.simpleString()
    r = got.first()
    assert [tuple(u) for u in r["unresolved"]] == [("risk_factor_deltas[0].citation", "not_found"), ("going_concern.citation", "ambiguous")]
    assert r["record"]["guidance_tone"]["citation"]["source_quote"] == "rose by ten  percent"  # the text's own spelling
    spans = [tuple(c["citation"]["source_span"]) for c in r["record"]["accrual_flags"]]
    assert spans == [(30, 40), (42, 52)] and r["record"]["going_concern"]["citation"]["source_span"] is None and r["record"]["cik"] == "1"
