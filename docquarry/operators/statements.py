"""Bitemporal statement views over reported facts.

A fact is (cik, kind, concept, period_end, qtrs, v) with what reported it: (accepted, accn, line). ``qtrs`` is the number of quarters that a
value spans up to the period's end, 0 for an instant. A fact is reported again and again: its first report is what was known then ("as
reported"), its last what is known now ("most recently reported"). Views have one row a company and period, though its columns were filed
apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT = ["cik", "kind", "concept", "period_end", "qtrs"]


def reported(facts: DataFrame, last: bool = False) -> DataFrame:
    """(FACT, v, accepted): each fact as first, or ``last``, reported; ties by accn, line, value. One partial aggregate: a fact that was reported
    very often is no larger than any other after it."""
    pick = F.max if last else F.min
    one = facts.groupBy(*FACT).agg(pick(F.struct("accepted", "accn", "line", "v")).alias("x"))
    return one.select(*FACT, "x.v", "x.accepted")


def known_at(facts: DataFrame, at: Column) -> DataFrame:
    """(FACT, v, accepted): each fact as it was known at a time: its last report by then."""
    return reported(facts.where(F.col("accepted") <= at), True)


def intervals(facts: DataFrame) -> DataFrame:
    """(FACT, v, known_from, known_to): for how long each report of a fact was the last one. Of reports accepted at once, the last counts;
    ``known_to`` of the one that still holds is null. A read as known at t is the rows with known_from <= t < known_to."""
    at_once = facts.groupBy(*FACT, "accepted").agg(F.max(F.struct("accn", "line", "v"))["v"].alias("v"))
    following = F.lead("accepted").over(Window.partitionBy(*FACT).orderBy("accepted"))
    return at_once.select(*FACT, "v", F.col("accepted").alias("known_from"), following.alias("known_to"))


def quarterly(facts: DataFrame) -> DataFrame:
    """(cik, kind, concept, period_end, v, accepted) of single quarters, from ``reported`` (or ``known_at``) facts: instants as they are; flows as
    reported for one quarter, otherwise what the year to date grew by since the quarter before, known once both are.

    A year's facts of one company and concept meet in one row, by a partial aggregate, and give up to four quarters."""
    year, quarter = F.year("period_end"), F.quarter("period_end")
    fact = F.struct("v", "accepted", "period_end")
    one = lambda i: F.max(F.when((quarter == i) & (F.col("qtrs") == 1), fact)).alias(f"d{i}")
    to_date = lambda i: F.max(F.when((quarter == i) & (F.col("qtrs") == i), fact)).alias(f"y{i}")
    flows = facts.where("qtrs > 0").groupBy("cik", "kind", "concept", year.alias("fy")).agg(*(f(i) for i in range(1, 5) for f in (one, to_date)))

    def derived(i: int) -> Column:
        own, now = F.col(f"d{i}"), F.col(f"y{i}")
        if i == 1:
            return own
        was = F.col(f"y{i - 1}")
        grown = F.struct((now["v"] - was["v"]).alias("v"), F.greatest(now["accepted"], was["accepted"]).alias("accepted"), now["period_end"].alias("period_end"))
        return F.coalesce(own, F.when(now.isNotNull() & was.isNotNull(), grown))

    each = flows.select("cik", "kind", "concept", F.explode(F.array(*map(derived, range(1, 5)))).alias("q")).where("q is not null")
    cols = ["cik", "kind", "concept", "period_end", "v", "accepted"]
    return each.select("cik", "kind", "concept", "q.period_end", "q.v", "q.accepted").select(*cols).unionByName(facts.where("qtrs = 0").select(*cols))


def yearly(facts: DataFrame) -> DataFrame:
    """(cik, kind, concept, period_end, v, accepted) of whole years: flows over four quarters, and instants at a year's end."""
    last = F.quarter("period_end") == 4
    return facts.where(((F.col("qtrs") == 4) | (F.col("qtrs") == 0)) & last).select("cik", "kind", "concept", "period_end", "v", "accepted")


def statement(values: DataFrame, kind: str, concepts: list[str]) -> DataFrame:
    """One row a company and period of a ``kind``: a column a concept (null if unknown), ``first_known`` and ``known`` (when the first and the
    last of its values were accepted). Concepts are a catalogue, so the pivot is one partial aggregate."""
    at = [F.max(F.when(F.col("concept") == c, F.col("v"))).alias(c) for c in concepts]
    rows = values.where((F.col("kind") == kind) & F.col("concept").isin(*concepts))
    return rows.groupBy("cik", "period_end").agg(*at, F.min("accepted").alias("first_known"), F.max("accepted").alias("known"))


def view(facts: DataFrame, kind: str, concepts: list[str], last: bool, annual: bool) -> DataFrame:
    """A statement view: as first reported or most recently (``last``), of quarters or of years (``annual``)."""
    own = facts.where(F.col("kind") == kind)
    return statement((yearly if annual else quarterly)(reported(own, last)), kind, concepts)


def rolling_year(quarters: DataFrame) -> DataFrame:
    """(cik, kind, concept, period_end, v, accepted) over the four quarters that end at each of ``quarterly``'s; without a row where one of
    them is missing. Instants aren't added up: leave them out before."""
    w = Window.partitionBy("cik", "kind", "concept").orderBy("period_end")
    number = F.year("period_end") * 4 + F.quarter("period_end")
    four = w.rowsBetween(-3, 0)
    got = quarters.select("cik", "kind", "concept", "period_end", F.sum("v").over(four).alias("v"), F.max("accepted").over(four).alias("accepted"), (number - F.lag(number, 3).over(w)).alias("span"))
    return got.where("span = 3").drop("span")
