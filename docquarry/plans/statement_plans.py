"""Statement views over orders (filings) and lineitem (facts), and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import statements as op
from docquarry.plans.common import table
from docquarry.plans.registry import register

S = SparkSession
#: A statement's concepts, by return flag.
CONCEPTS = {"income": {"A": "revenue", "N": "cost", "R": "profit"}, "balance": {"A": "assets", "N": "liabilities", "R": "equity"}, "cash": {"A": "operating", "N": "investing", "R": "financing"}}
KINDS = list(CONCEPTS)
KNOWN_AT = "1998-06-30"


def facts(spark: S, d: str) -> DataFrame:
    """Every line is a report of a fact: its order is the filing, accepted at the order's date; the period ended one to three quarters before;
    flows span one quarter or the year to date."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("accn"), F.col("o_orderdate").alias("accepted"), (F.col("o_custkey") % 60).alias("cik"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("line"), "l_suppkey", "l_partkey", "l_returnflag", F.col("l_extendedprice").alias("v"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("l_suppkey") % 3).cast("int"))
    names = F.create_map(*[F.lit(x) for k, c in CONCEPTS.items() for f, n in c.items() for x in (k + f, n)])
    end = F.date_sub(F.add_months(F.trunc("accepted", "quarter"), -3 * (F.col("line") % 3)), 1)
    rows = li.join(o, "accn").withColumn("kind", kind).withColumn("period_end", end)
    qtrs = F.when(F.col("kind") == "balance", 0).when(F.col("l_partkey") % 3 == 0, 1).otherwise(F.quarter("period_end"))
    return rows.select("cik", "kind", names[F.concat("kind", "l_returnflag")].alias("concept"), "period_end", qtrs.alias("qtrs"), "v", "accepted", "accn", "line")


_NAMES = " ".join(f"when '{k}{f}' then '{n}'" for k, c in CONCEPTS.items() for f, n in c.items())
_FACTS = f"""facts as (select cik, kind, case kind || flag {_NAMES} end as concept, period_end, case when kind = 'balance' then 0 when part % 3 = 0 then 1 else quarter(period_end) end as qtrs, v, accepted, accn, line
 from (select o_custkey % 60 as cik, list_extract(['income', 'balance', 'cash'], (l_suppkey % 3 + 1)::int) as kind, l_returnflag as flag, l_partkey as part, (date_trunc('quarter', o_orderdate) - interval 3 month * (l_linenumber % 3) - interval 1 day)::date as period_end,
 l_extendedprice as v, o_orderdate as accepted, o_orderkey as accn, l_linenumber as line from orders join lineitem on l_orderkey = o_orderkey))"""
_KEY = "cik, kind, concept, period_end, qtrs"


def _one(last: bool, where: str = "true") -> str:
    way = "desc" if last else "asc"
    return f"one as (select {_KEY}, v, accepted from (select *, row_number() over (partition by {_KEY} order by accepted {way}, accn {way}, line {way}, v {way}) as k from facts where {where}) where k = 1)"


#: A quarter's own value, or what the year to date grew by: by a join of each fact with that of the quarter before.
_QUARTERS = """quarters as (select cik, kind, concept, period_end, v, accepted from one where qtrs <= 1
 union all select n.cik, n.kind, n.concept, n.period_end, n.v - w.v, greatest(n.accepted, w.accepted) from one n join one w on w.cik = n.cik and w.kind = n.kind and w.concept = n.concept and year(w.period_end) = year(n.period_end) and w.qtrs = n.qtrs - 1
 and quarter(w.period_end) = w.qtrs where n.qtrs > 1 and quarter(n.period_end) = n.qtrs and not exists (select 1 from one s where s.cik = n.cik and s.kind = n.kind and s.concept = n.concept and s.period_end = n.period_end and s.qtrs = 1))"""
_YEARS = "years as (select cik, kind, concept, period_end, v, accepted from one where qtrs in (0, 4) and quarter(period_end) = 4)"


def _pivot_sql(source: str, kind: str) -> str:
    cols = ", ".join(f"round(max(v) filter (where concept = '{c}'), 2) as {c}" for c in CONCEPTS[kind].values())
    return f"select cik, period_end, {cols}, min(accepted) as first_known, max(accepted) as known from {source} where kind = '{kind}' group by cik, period_end"


def _rounded(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in CONCEPTS[kind].values()})


def _view(kind: str, last: bool, annual: bool) -> Callable[[S, str], DataFrame]:
    def run(spark: S, d: str) -> DataFrame:
        return _rounded(op.view(facts(spark, d), kind, list(CONCEPTS[kind].values()), last, annual), kind)

    return run


for _kind in KINDS:
    for _last in (False, True):
        for _annual in (False, True):
            _rows = _YEARS if _annual else _QUARTERS
            _sql = f"with {_FACTS}, {_one(_last)}, {_rows} {_pivot_sql('years' if _annual else 'quarters', _kind)}"
            register(f"{_kind}_{'mr' if _last else 'ar'}{'y' if _annual else 'q'}", _sql)(_view(_kind, _last, _annual))


@register("income_known_at", f"with {_FACTS}, {_one(True, f'accepted <= timestamp {KNOWN_AT!r}')}, {_QUARTERS} {_pivot_sql('quarters', 'income')}")
def income_known_at(spark: S, d: str) -> DataFrame:
    """The quarterly income statements as they were known at a date."""
    known = op.known_at(facts(spark, d), F.lit(KNOWN_AT).cast("timestamp_ntz"))
    return _rounded(op.statement(op.quarterly(known), "income", list(CONCEPTS["income"].values())), "income")


@register("fact_intervals", f"with {_FACTS}, x as (select {_KEY}, accepted, arg_max(v, (accn, line, v)) as v from facts group by all) select {_KEY}, v, accepted as known_from, lead(accepted) over (partition by {_KEY} order by accepted) as known_to from x")
def fact_intervals(spark: S, d: str) -> DataFrame:
    return op.intervals(facts(spark, d))


@register("rolling_year", f"with {_FACTS}, {_one(True)}, {_QUARTERS}, n as (select *, year(period_end) * 4 + quarter(period_end) as i from quarters where kind <> 'balance') select a.cik, a.kind, a.concept, a.period_end, round(sum(b.v), 2) as v, max(b.accepted) as accepted from n a join n b on b.cik = a.cik and b.kind = a.kind and b.concept = a.concept and b.i between a.i - 3 and a.i group by a.cik, a.kind, a.concept, a.period_end having count(*) = 4")
def rolling_year(spark: S, d: str) -> DataFrame:
    quarters = op.quarterly(op.reported(facts(spark, d).where("kind <> 'balance'"), True))
    return op.rolling_year(quarters).withColumn("v", F.round("v", 2))
