"""Point-in-time reads, restatement views, signals and statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.outcomes import checked_haircut
from docquarry.operators import analytics as op
from docquarry.operators import dependence
from docquarry.operators import pit
from docquarry.plans.common import sql_values, table
from docquarry.plans.registry import register
from docquarry.session import materialize

S = SparkSession


# --- point in time ------------------------------------------------------------------------------------------------------------------
def _features(spark: S, d: str) -> DataFrame:
    """Views and clicks as feature rows; naive times become UTC here, at the boundary."""
    e = table(spark, d, "events").where("event_type in ('view', 'click')")
    return pit.with_cutoff(e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("event_datetime"), "value"))


def _spine(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("spine_id"), "user_id", F.col("ts").cast("timestamp").alias("t"))


#: Fixed values for the SQL side: sessions of January and February 2024 (New York), all closing at 16:00, 21:00 UTC.
_CAL_SQL = "cal as (select d::date as et_date, (select min(s) from range(date '2024-01-01', date '2024-02-20', interval 1 day) x(s) where s > d and dayofweek(s) between 1 and 5 and s not in (timestamp '2024-01-01', timestamp '2024-01-15', timestamp '2024-02-19')) + interval 21 hour as closes from range(date '2023-12-30', date '2024-02-10', interval 1 day) y(d))"
_FEAT_SQL = f"{_CAL_SQL}, f as (select event_id, user_id, ts, value, closes as as_of from events join cal on et_date = (ts - interval 5 hour)::date where event_type in ('view', 'click')), p as (select event_id as spine_id, user_id, ts as t from events where event_type = 'purchase')"


@register("pit_cutoff", f"with {_FEAT_SQL} select event_id, epoch(as_of)::bigint as as_of_epoch from f")
def pit_cutoff(spark: S, d: str) -> DataFrame:
    return _features(spark, d).select("event_id", F.unix_timestamp("as_of_ts").alias("as_of_epoch"))


@register("materialize_pit", f"with {_FEAT_SQL} select user_id, floor(epoch(ts))::bigint as event_epoch, epoch(as_of)::bigint as as_of_epoch, value from f")
def materialize_pit(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('view', 'click')").select("user_id", F.col("ts").cast("timestamp").alias("event_datetime"), "value")
    m = pit.materialize_features(e, ["user_id", "event_datetime", "value"])
    return m.select("user_id", F.unix_timestamp("event_datetime").alias("event_epoch"), F.unix_timestamp("as_of_ts").alias("as_of_epoch"), "value")


def _joined_sql(ttl: int = 0) -> str:
    fresh = f" and as_of >= t - interval {ttl} day" if ttl else ""
    return f"with {_FEAT_SQL}, j as (select p.spine_id, f.event_id, f.value, f.as_of, p.t, row_number() over (partition by spine_id order by as_of desc, ts desc, event_id desc) as r from p left join f on f.user_id = p.user_id and f.as_of <= p.t) select spine_id, case when true{fresh} then event_id end as event_id, case when true{fresh} then value end as value from j where r = 1"


def _asof(spark: S, d: str, ttl: int) -> DataFrame:
    f = _features(spark, d).withColumn("tie", F.struct("event_datetime", "event_id"))
    return pit.as_of(_spine(spark, d), f, "user_id", "t", ["event_id", "value"], ttl, tie="tie").select("spine_id", "event_id", "value")


@register("pit_asof_join", _joined_sql())
def pit_asof_join(spark: S, d: str) -> DataFrame:
    return _asof(spark, d, 0)


@register("pit_ttl", _joined_sql(3))
def pit_ttl(spark: S, d: str) -> DataFrame:
    return _asof(spark, d, 3)


@register("feature_service", f"with a as ({_joined_sql()}), b as ({_joined_sql(3)}) select a.spine_id, a.value as long_value, b.value as short_value from a join b using (spine_id)")
def feature_service(spark: S, d: str) -> DataFrame:
    f = _features(spark, d).withColumn("tie", F.struct("event_datetime", "event_id"))
    first = pit.as_of(_spine(spark, d), f, "user_id", "t", ["value"], 0, tie="tie").withColumnRenamed("value", "long_value").drop("as_of_ts")
    return pit.as_of(first, f, "user_id", "t", ["value"], 3, tie="tie").select("spine_id", "long_value", F.col("value").alias("short_value"))


@register("online_latest", f"with {_FEAT_SQL} select user_id, event_id from (select *, row_number() over (partition by user_id order by as_of desc, ts desc, event_id desc) as r from f where as_of between timestamp '2024-01-05' and timestamp '2024-01-20') where r = 1")
def online_latest(spark: S, d: str) -> DataFrame:
    return pit.online_latest(_features(spark, d), "user_id", "2024-01-05", "2024-01-20").select("user_id", "event_id")


# --- restatements -------------------------------------------------------------------------------------------------------------------
_FACT_SQL = "(select o_custkey as cik, l_returnflag as concept, l_shipdate as accepted, l_orderkey as accn, l_linenumber as line, floor(l_extendedprice)::bigint as v from lineitem join orders on o_orderkey = l_orderkey)"


def _facts(spark: S, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("cik"), F.col("l_returnflag").alias("concept"), F.col("l_shipdate").alias("accepted"), F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("line"), F.floor("l_extendedprice").alias("v"))


def _reported(spark: S, d: str, last: bool) -> DataFrame:
    """As first (or most recently) reported: one aggregate, the extreme of (accepted, accn, line, value), then a pivot over known concepts."""
    pick = F.max if last else F.min
    one = _facts(spark, d).groupBy("cik", "concept").agg(pick(F.struct("accepted", "accn", "line", "v"))["v"].alias("v"))
    at = lambda c: F.max(F.when(F.col("concept") == c, F.col("v"))).alias(c.lower())
    return one.groupBy("cik").agg(at("A"), at("N"), at("R"))


def _reported_sql(order: str) -> str:
    o = ", ".join(f"{c} {order}" for c in ("accepted", "accn", "line", "v"))
    return f"select cik, max(v) filter (where concept = 'A') as a, max(v) filter (where concept = 'N') as n, max(v) filter (where concept = 'R') as r from (select *, row_number() over (partition by cik, concept order by {o}) as k from {_FACT_SQL}) where k = 1 group by cik"


@register("xbrl_arq", _reported_sql("asc"))
def xbrl_arq(spark: S, d: str) -> DataFrame:
    return _reported(spark, d, False)


@register("xbrl_mrq", _reported_sql("desc"))
def xbrl_mrq(spark: S, d: str) -> DataFrame:
    return _reported(spark, d, True)


@register("concept_priority", f"select cik, concept, v from (select *, row_number() over (partition by cik order by case when cik % 10 = 0 and concept = 'R' then -1 when concept = 'N' then 0 when concept = 'A' then 1 else 2 end, accepted, accn, line, v) as k from {_FACT_SQL}) where k = 1")
def concept_priority(spark: S, d: str) -> DataFrame:
    rank = F.when((F.col("cik") % 10 == 0) & (F.col("concept") == "R"), -1).when(F.col("concept") == "N", 0).when(F.col("concept") == "A", 1).otherwise(2)
    best = _facts(spark, d).groupBy("cik").agg(F.min(F.struct(rank.alias("p"), "accepted", "accn", "line", "v", "concept")).alias("x"))
    return best.select("cik", "x.concept", "x.v")


@register("ticker_history", "select o_orderkey, case when o_orderdate < timestamp '1997-06-01' then 'OLD' else 'NEW' end || o_custkey % 3 as ticker from orders where o_custkey % 3 <> 2 or o_orderdate < timestamp '1997-06-01'")
def ticker_history(spark: S, d: str) -> DataFrame:
    rows = [(k, f"OLD{k}", "1990-01-01", "1997-06-01") for k in range(3)] + [(k, f"NEW{k}", "1997-06-01", None) for k in range(2)]
    h = spark.createDataFrame(rows, "k int, ticker string, lo string, hi string").select("k", "ticker", F.to_timestamp_ntz("lo").alias("lo"), F.to_timestamp_ntz("hi").alias("hi"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 3).cast("int").alias("k"))
    return o.join(F.broadcast(h), "k").where((F.col("o_orderdate") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("o_orderdate") < F.col("hi")))).select("o_orderkey", "ticker")


@register("link_fact", f"select f.accn, f.line, o.o_orderstatus as form from {_FACT_SQL} f join orders o on o.o_orderkey = f.accn")
def link_fact(spark: S, d: str) -> DataFrame:
    forms = table(spark, d, "orders").select(F.col("o_orderkey").alias("accn"), F.col("o_orderstatus").alias("form"))
    return _facts(spark, d).select("accn", "line").join(forms, "accn")


# --- prices and signals -------------------------------------------------------------------------------------------------------------
_PRICE_SQL = "px as (select l_suppkey as k, l_shipdate as day, sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) as volume from lineitem group by all)"


def _prices(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("day")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


_RET_SQL = f"{_PRICE_SQL}, r as (select *, ln(close / lag(close, 1) over (partition by k order by day)) as ret_1, ln(close / lag(close, 5) over (partition by k order by day)) as ret_5, ln(lead(close, 1) over (partition by k order by day) / close) as next_1 from px)"


@register("price_windows", f"with {_RET_SQL} select k, epoch(day)::bigint as day, round(ret_1, 4) + 0.0 as ret_1, round(ret_5, 4) + 0.0 as ret_5, round(case when count(ret_1) over w = 20 then stddev_samp(ret_1) over w * sqrt(252) end, 3) as vol_20, round(case when count(volume) over w = 20 then avg(volume) over w end, 5) as adv_20 from r window w as (partition by k order by day rows between 19 preceding and current row)")
def price_windows(spark: S, d: str) -> DataFrame:
    p = op.price_windows(_prices(spark, d), "k", "day", "close", "volume")
    return p.select("k", F.unix_timestamp(F.col("day").cast("timestamp")).alias("day"), (F.round("ret_1", 4) + 0.0).alias("ret_1"), (F.round("ret_5", 4) + 0.0).alias("ret_5"), F.round("vol_20", 3).alias("vol_20"), F.round("adv_20", 5).alias("adv_20"))


_DAY = "date_diff('day', date '2024-01-01', ts::date)"


def _event_days(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))


@register("signal_a1", f"with m as (select user_id, event_id, {_DAY} as day from events where event_type = 'view'), x as (select a.event_id, a.user_id, a.day, round(sum(exp(-0.05 * (a.day - b.day))), 6) as idx from m a join m b on a.user_id = b.user_id and b.day between a.day - 60 and a.day group by all) select event_id, idx as index, ntile(5) over (partition by day order by idx, event_id)::int as bucket from x")
def signal_a1(spark: S, d: str) -> DataFrame:
    views = _event_days(spark, d).where("event_type = 'view'").select("event_id", "user_id", "day")
    got = op.decayed_index(views, "user_id", "day", 60, 0.05).withColumn("index", F.round("index", 6))
    return op.quintiles(got, "day", "index", "event_id").select("event_id", "index", "bucket")


#: Sessions around the events' days: (day, how many sessions there have been by its end).
_FIRST, _LAST = dt.date(2024, 1, 1), dt.date(2024, 3, 31)
_SESSIONS = sorted({s for _, s, _ in pit.calendar_rows() if str(_FIRST) <= str(s) <= str(_LAST)})
_ORDINALS = [(str(day), sum(str(s) <= str(day) for s in _SESSIONS)) for day in (_FIRST + dt.timedelta(i) for i in range((_LAST - _FIRST).days + 1))]


@register("signal_a2", f"with e as (select event_id, user_id, event_type, n as session from events join {sql_values(_ORDINALS, 'day, n')} on day = strftime(ts, '%Y-%m-%d')) select p.event_id, count(v.event_id) as n from (select * from e where event_type = 'signup') p left join (select * from e where event_type = 'view') v on v.user_id = p.user_id and v.session - p.session between 5 and 20 group by p.event_id")
def signal_a2(spark: S, d: str) -> DataFrame:
    """Views 5 to 20 sessions of the exchange after each sign-up."""
    days = F.broadcast(spark.createDataFrame(_ORDINALS, "day string, session int"))
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(days, "day")
    w = Window.partitionBy("user_id").orderBy("session").rangeBetween(5, 20)
    return e.withColumn("n", F.count_if(F.col("event_type") == "view").over(w)).where("event_type = 'signup'").select("event_id", "n")


@register("signal_b1", f"with e as (select event_id, user_id, {_DAY} as day, case event_type when 'purchase' then 1 when 'error' then -1 else 0 end as s from events) select event_id, sum(s) over (partition by user_id order by day range between 5 preceding and current row)::bigint as score from e")
def signal_b1(spark: S, d: str) -> DataFrame:
    s = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("day").rangeBetween(-5, 0)
    return _event_days(spark, d).select("event_id", F.sum(s).over(w).alias("score"))


@register("event_study", f"with {_RET_SQL}, n as (select *, row_number() over (partition by k order by day) as i from r) select a.k, a.i::int as i, round(sum(b.ret_1) + 1.234e-9, 6) as car, count(b.ret_1) as n from n a join n b on b.k = a.k and b.i between a.i - 2 and a.i + 2  group by all")
def event_study(spark: S, d: str) -> DataFrame:
    p = op.price_windows(_prices(spark, d), "k", "day", "close", "volume")
    order = Window.partitionBy("k").orderBy("day")
    w = order.rowsBetween(-2, 2)
    got = p.withColumn("i", F.row_number().over(order)).withColumn("car", F.round(F.sum("ret_1").over(w) + 1.234e-9, 6)).withColumn("n", F.count("ret_1").over(w))
    return got.select("k", "i", "car", "n")


def _panel(spark: S, d: str) -> DataFrame:
    """(month, key, signal, outcome): monthly rows with the next row's return."""
    p = op.price_windows(_prices(spark, d), "k", "day", "close", "volume")
    nxt = F.log(F.lead("close", 1).over(Window.partitionBy("k").orderBy("day")) / F.col("close"))
    return p.withColumn("next_1", F.round(nxt, 8)).withColumn("ret_1", F.round("ret_1", 8)).withColumn("month", F.date_format("day", "yyyy-MM")).where("ret_1 is not null and next_1 is not null")


_PANEL_SQL = f"{_RET_SQL}, panel as (select k, day, strftime(day, '%Y-%m') as month, round(ret_1, 8) as ret_1, round(next_1, 8) as next_1, volume from r where ret_1 is not null and next_1 is not null)"


#: Rows ahead that the signal is judged by.
_HORIZONS = (1, 5, 20)


def _ic_sql() -> str:
    forward = ", ".join(f"round(ln(lead(close, {h}) over w / close), 8) as fwd_{h}" for h in _HORIZONS)
    long = " union all ".join(f"select {h} as horizon, day, signal, fwd_{h} as y from r" for h in _HORIZONS)
    rank = lambda c: f"rank() over (partition by horizon, day order by {c}) + (count(*) over (partition by horizon, day, {c}) - 1) / 2.0"
    return f"""with {_PRICE_SQL}, r as (select day::date as day, round(ln(close / lag(close, 1) over w), 8) as signal, {forward} from px where day is not null window w as (partition by k order by day)),
    f as ({long}), x as (select horizon, day, {rank("signal")} as a, {rank("y")} as b from f where signal is not null and y is not null),
    c as (select horizon, day, corr(a, b) as ic from x group by horizon, day having count(*) > 2), i as (select horizon, day, case when isfinite(ic) then round(ic, 8) + 0.0 end as ic from c),
    p as (select horizon, count(ic) as n, avg(ic) as mean, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) as t from i group by horizon)
    select horizon::int as horizon, strftime(day, '%Y-%m-%d') as day, ic, n, round(mean, 6) + 0.0 as mean, round(t, 3) + 0.0 as t, round(mean / nullif((select mean from p order by horizon limit 1), 0), 4) + 0.0 as decay from i join p using (horizon)"""


@register("ic_analysis", _ic_sql())
def ic_analysis(spark: S, d: str) -> DataFrame:
    """The information coefficients of all dates by horizon, each horizon's mean and t, and how the mean decays from the shortest one.
    They are few rows, which are written once and read for both."""
    p = op.price_windows(_prices(spark, d).where("day is not null"), "k", "day", "close", "volume")
    p = op.forward_returns(p, "k", "day", "close", _HORIZONS)
    panel = p.select(F.to_date("day").alias("day"), F.round("ret_1", 8).alias("ret_1"), *[F.round(f"fwd_{h}", 8).alias(f"fwd_{h}") for h in _HORIZONS])
    ics = op.ic_by_horizon(panel, "day", "ret_1", {h: f"fwd_{h}" for h in _HORIZONS}, least=3)
    ics = materialize(ics.withColumn("ic", F.round("ic", 8) + 0.0), "ics")
    stats = op.ic_summary(ics, "horizon", "ic").select("horizon", "n", *[(F.round(c, digits) + 0.0).alias(c) for c, digits in (("mean", 6), ("t", 3), ("decay", 4))])
    return ics.join(F.broadcast(stats), "horizon").select("horizon", F.date_format("day", "yyyy-MM-dd").alias("day"), "ic", "n", "mean", "t", "decay")


@register("quantile_sort", f"with {_PANEL_SQL}, q as (select *, ntile(5) over (partition by month order by ret_1, k, day) as bucket from panel) select bucket::int as bucket, count(*) as n, round(avg(next_1), 7) as mean, round(var_samp(next_1), 5) as variance from q group by bucket")
def quantile_sort(spark: S, d: str) -> DataFrame:
    q = _panel(spark, d).withColumn("bucket", F.ntile(5).over(Window.partitionBy("month").orderBy("ret_1", "k", "day")))
    return q.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("next_1"), 7).alias("mean"), F.round(F.var_samp("next_1"), 5).alias("variance"))


@register("conditional_dist", f"with {_PANEL_SQL} select ret_1 > 0 as up, count(*) as n, round(avg((next_1 > 0)::int), 8) as hit_rate, round(avg((next_1 > 0)::int) / (select avg((next_1 > 0)::int) from panel), 8) as lift from panel group by up")
def conditional_dist(spark: S, d: str) -> DataFrame:
    panel = _panel(spark, d)
    hit = F.avg((F.col("next_1") > 0).cast("int"))
    base = panel.agg(hit.alias("base"))
    got = panel.groupBy((F.col("ret_1") > 0).alias("up")).agg(F.count("*").alias("n"), hit.alias("h")).join(F.broadcast(base))
    return got.select("up", "n", F.round("h", 8).alias("hit_rate"), F.round(F.col("h") / F.col("base"), 8).alias("lift"))


@register("triple_barrier", "with p as (select o_custkey, l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as step, l_discount - 0.05 as ret from lineitem join orders on o_orderkey = l_orderkey), h as (select l_orderkey, min(step) filter (where round(ret, 4) >= 0.03) as u, min(step) filter (where round(ret, 4) <= -0.03) as d from p group by l_orderkey) select l_orderkey, case when u is null and d is null then 0 when d is null or u < d then 1 else -1 end::int as label from h")
def triple_barrier(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    path = table(spark, d, "lineitem").join(o, "l_orderkey").withColumn("step", F.row_number().over(w)).withColumn("ret", F.round(F.col("l_discount") - 0.05, 4))
    return op.triple_barrier(path, "l_orderkey", "step", "ret", 0.03, -0.03)


@register("cpcv_splits", """with s as (select doc_id as a, doc_id + 5 as z, ntile(6) over (order by doc_id) as block from documents), sp as (select block, min(a) as lo, max(z) as hi from s group by block),
 f as (select row_number() over (order by x.block, y.block) - 1 as fold, x.block as b1, y.block as b2, x.lo as lo1, x.hi as hi1, y.lo as lo2, y.hi as hi2 from sp x join sp y on x.block < y.block)
 select fold::int as fold, case when block in (b1, b2) then 'test' when (a <= hi1 + 10 and z >= lo1) or (a <= hi2 + 10 and z >= lo2) then 'purged' else 'train' end as role, count(*) as n from s, f group by all""")
def cpcv_splits(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 5).alias("z"))
    return op.cpcv_roles(s, "a", "z", 6, 2, 10).groupBy("fold", "role").agg(F.count("*").alias("n"))


@register("realistic_costs", "select event_id, round(5 + 10 * sqrt(value / 1000), 8) as bps from events")
def realistic_costs(spark: S, d: str) -> DataFrame:
    from docquarry.functions.numbers import cost_bps

    return table(spark, d, "events").select("event_id", F.round(cost_bps(F.lit(5.0), F.col("value") / 1000), 8).alias("bps"))


_T2_SQL = f"{_PANEL_SQL}, w as (select month, k, day, next_1, greatest(-0.05, least(0.05, ret_1 - avg(ret_1) over (partition by month))) as wt from panel)"


def _t2(spark: S, d: str) -> DataFrame:
    neutral = F.col("ret_1") - F.avg("ret_1").over(Window.partitionBy("month"))
    return _panel(spark, d).withColumn("wt", F.greatest(F.lit(-0.05), F.least(F.lit(0.05), neutral)))


@register("t2_portfolio", f"with {_T2_SQL} select month, round(sum(wt * next_1), 3) as pnl, round(sum(abs(wt)), 3) as gross from w group by month")
def t2_portfolio(spark: S, d: str) -> DataFrame:
    return _t2(spark, d).groupBy("month").agg(F.round(F.sum(F.col("wt") * F.col("next_1")), 3).alias("pnl"), F.round(F.sum(F.abs("wt")), 3).alias("gross"))


@register("stress", f"with {_T2_SQL} select s.scale, round(sum(wt * next_1 - abs(wt) * 0.0005 * s.scale), 2) as pnl from w, (values (1.0::double), (2.0), (0.8), (1.2)) as s(scale) group by s.scale")
def stress(spark: S, d: str) -> DataFrame:
    scales = F.broadcast(spark.createDataFrame([(1.0,), (2.0,), (0.8,), (1.2,)], "scale double"))
    net = F.col("wt") * F.col("next_1") - F.abs("wt") * 0.0005 * F.col("scale")
    return _t2(spark, d).join(scales).groupBy("scale").agg(F.round(F.sum(net), 2).alias("pnl"))


@register("gates", f"with {_T2_SQL}, m as (select month, sum(wt * next_1) as pnl from w group by month) select count(*) as months, count(*) >= 12 and avg(pnl) > 0 as passes from m")
def gates(spark: S, d: str) -> DataFrame:
    m = _t2(spark, d).groupBy("month").agg(F.sum(F.col("wt") * F.col("next_1")).alias("pnl"))
    return m.agg(F.count("*").alias("months"), ((F.count("*") >= 12) & (F.avg("pnl") > 0)).alias("passes"))


@register("haircut", "select event_id, round(value * (user_id % 11) / 10.0, 6) as size from events where user_id % 11 <= 10")
def haircut(spark: S, d: str) -> DataFrame:
    h = checked_haircut((F.col("user_id") % 11) / 10.0)
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * h, 6).alias("size"))


def _harmonic(n: str) -> str:
    """Digamma of a whole number, less Euler's constant, which cancels out: a harmonic number."""
    return f"coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0::double / i)), 0)"


@register(
    "mutual_info",
    f"""with c as (select row_number() over () as id, c_nationkey, c_acctbal as x, c_acctbal * 0.5 + c_nationkey + (c_custkey % 17) * 300 as y from customer), d as (select a.c_nationkey, a.id, abs(a.x - b.x) as dx, abs(a.y - b.y) as dy from c a join c b on a.c_nationkey = b.c_nationkey and a.id <> b.id),
    e as (select id, list_extract(list_sort(list(greatest(dx, dy))), 3) as eps from d group by id having count(*) >= 3), k as (select c_nationkey, id, count(*) filter (where dx < eps) as nx, count(*) filter (where dy < eps) as ny from d join e using (id) group by all),
    m as (select c_nationkey, avg({_harmonic('nx + 1')} + {_harmonic('ny + 1')}) as s from k group by c_nationkey), n as (select c_nationkey, count(*) as n from customer group by c_nationkey)
    select c_nationkey, n, case when s is not null then round(greatest({_harmonic('3')} + {_harmonic('n')} - s, 0), 6) end as mi from n left join m using (c_nationkey)""",
)
def mutual_info(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("y", F.col("c_acctbal") * 0.5 + F.col("c_nationkey") + (F.col("c_custkey") % 17) * 300)
    return dependence.mutual_information(c, "c_nationkey", "c_acctbal", "y").withColumn("mi", F.round("mi", 6))


def _means_sql(source: str, key: str, value: str, draws: int) -> str:
    weight = "case " + " ".join(f"when u < {t!r}::double then {k}" for k, t in enumerate(op.POISSON)) + " else 8 end"
    unit = f"('0x' || substr(md5('0:' || replicate || ':' || {key}), 1, 8))::bigint / 4294967296.0::double"
    return f"select replicate::int as replicate, sum(w * x) / sum(w) as mean from (select replicate, x, {weight} as w from (select replicate, {value} as x, {unit} as u from {source}, range({draws}) as r(replicate))) group by replicate"


@register("bootstrap", f"select replicate, round(mean, 6) as mean from ({_means_sql('events', 'event_id', 'value', 100)})")
def bootstrap(spark: S, d: str) -> DataFrame:
    return op.bootstrap_means(table(spark, d, "events"), "event_id", "value", 100).withColumn("mean", F.round("mean", 6))


@register(
    "event_study_ci",
    f"""with {_RET_SQL}, c as (select *, k || '/' || day::date as key, ret_1 + coalesce(lead(ret_1) over (partition by k order by day), 0) as car from r), v as (select key, avg(car) as car from c where car is not null group by key), m as ({_means_sql('v', 'key', 'car', 60)})
    select round((select avg(car) from v), 5) + 0.0 as mean, round(quantile_cont(mean, 0.025), 5) + 0.0 as lo, round(quantile_cont(mean, 0.975), 5) + 0.0 as hi from m""",
)
def event_study_ci(spark: S, d: str) -> DataFrame:
    """The mean of two days' cumulative returns over all days, with its bootstrap interval."""
    p = op.price_windows(_prices(spark, d), "k", "day", "close", "volume")
    car = F.col("ret_1") + F.coalesce(F.lead("ret_1").over(Window.partitionBy("k").orderBy("day")), F.lit(0.0))
    v = p.select(F.concat_ws("/", "k", F.date_format("day", "yyyy-MM-dd")).alias("key"), car.alias("car")).where("car is not null").groupBy("key").agg(F.avg("car").alias("car"))
    return op.bootstrap_interval(v, "key", "car", 60).select(*[(F.round(c, 5) + 0.0).alias(c) for c in ("mean", "lo", "hi")])


@register(
    "ic_decay",
    f"""with {_PANEL_SQL}, f as (select k, day, month, ret_1, next_1 as y, 1 as horizon from panel union all select k, day, month, ret_1, round(next_1 + lead(next_1) over (partition by k order by day), 8), 2 from panel), g as (select * from f where y is not null),
    x as (select horizon, month, rank() over (partition by horizon, month order by ret_1) + (count(*) over (partition by horizon, month, ret_1) - 1) / 2.0 as a, rank() over (partition by horizon, month order by y) + (count(*) over (partition by horizon, month, y) - 1) / 2.0 as b from g),
    i as (select horizon, month, corr(a, b) as ic from x group by all having count(*) > 2), p as (select horizon, count(ic) as n, avg(ic) as mean, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) as t from i group by horizon)
    select horizon, n, round(mean, 5) as mean, round(t, 3) as t, round(mean / (select mean from p where horizon = 1), 3) as decay from p""",
)
def ic_decay(spark: S, d: str) -> DataFrame:
    """Information coefficients by horizon: their mean, t and decay."""
    panel = _panel(spark, d)
    two = F.round(F.col("next_1") + F.lead("next_1").over(Window.partitionBy("k").orderBy("day")), 8)
    f = panel.withColumn("two", two).select("k", "month", "ret_1", F.inline(F.array(F.struct(F.lit(1).alias("horizon"), F.col("next_1").alias("y")), F.struct(F.lit(2).alias("horizon"), F.col("two").alias("y"))))).where("y is not null")
    f = f.withColumn("date", F.concat_ws(":", "horizon", "month"))
    ics = op.rank_ic(f, "date", "ret_1", "y", least=3).withColumn("horizon", F.split("date", ":")[0].cast("int"))
    return op.ic_summary(ics, "horizon", "ic").select("horizon", "n", F.round("mean", 5).alias("mean"), F.round("t", 3).alias("t"), F.round("decay", 3).alias("decay"))


@register(
    "quantile_spread",
    f"with {_PANEL_SQL}, q as (select *, ntile(5) over (partition by month order by ret_1, k, day) as bucket from panel), s as (select avg(next_1) filter (where bucket = 5) - avg(next_1) filter (where bucket = 1) as spread, var_samp(next_1) filter (where bucket = 5) / count(*) filter (where bucket = 5) + var_samp(next_1) filter (where bucket = 1) / count(*) filter (where bucket = 1) as v from q) select round(spread, 6) as spread, round(spread / sqrt(v), 4) as t from s",
)
def quantile_spread(spark: S, d: str) -> DataFrame:
    q = _panel(spark, d).withColumn("bucket", F.ntile(5).over(Window.partitionBy("month").orderBy("ret_1", "k", "day")))
    return op.welch_t(q, "bucket", "next_1", 5, 1).select(F.round("spread", 6).alias("spread"), F.round("t", 4).alias("t"))


_SCALED_SQL = f"""{_RET_SQL}, v as (select *, round(case when count(ret_1) over w = 20 then stddev_samp(ret_1) over w * sqrt(252) end, 8) as vol_20, case when count(volume) over w = 20 then avg(volume) over w end as adv_20 from r window w as (partition by k order by day rows between 19 preceding and current row)),
 pn as (select k, day, strftime(day, '%Y-%m') as month, k % 3 as universe, round(ret_1, 8) as ret_1, round(next_1, 8) as next_1, vol_20, adv_20 from v where ret_1 is not null and next_1 is not null),
 sc as (select *, (ret_1 - avg(ret_1) over (partition by month, universe)) * 0.1::double / nullif(vol_20, 0) as s, least(0.05::double, 0.1::double * adv_20 / 100) as most from pn),
 wt as (select *, case when s is not null and adv_20 is not null then greatest(-most, least(most, s)) else 0 end as weight from sc)"""


def _scaled(spark: S, d: str) -> DataFrame:
    panel = _panel(spark, d).withColumn("universe", F.col("k") % 3).withColumn("vol_20", F.round("vol_20", 8))
    return op.portfolio_weights(panel, "month", "ret_1", "vol_20", "adv_20", "universe", 0.1, 0.05, 100.0, 0.1)


@register("t2_scaled", f"with {_SCALED_SQL} select month, universe, round(sum(abs(weight)), 3) as gross, round(sum(weight * next_1), 3) + 0.0 as pnl from wt group by all")
def t2_scaled(spark: S, d: str) -> DataFrame:
    """Weights neutral in each part of the universe, scaled by volatility, within caps and participation."""
    return _scaled(spark, d).groupBy("month", "universe").agg(F.round(F.sum(F.abs("weight")), 3).alias("gross"), (F.round(F.sum(F.col("weight") * F.col("next_1")), 3) + 0.0).alias("pnl"))


@register(
    "stress_regimes",
    f"with {_SCALED_SQL}, m as (select month, sum(weight * next_1) as pnl, avg(next_1) as market from wt group by month), g as (select *, case when market < 0 then 'down' else 'up' end as regime from m) select regime, count(*) as months, round(sum(pnl), 3) + 0.0 as pnl, round(corr(pnl, market), 4) as correlation from g group by regime having count(*) > 2",
)
def stress_regimes(spark: S, d: str) -> DataFrame:
    """Profit in rising and falling markets, and how it goes with the market in each."""
    m = _scaled(spark, d).groupBy("month").agg(F.sum(F.col("weight") * F.col("next_1")).alias("pnl"), F.avg("next_1").alias("market"))
    got = m.groupBy(F.when(F.col("market") < 0, "down").otherwise("up").alias("regime")).agg(F.count("*").alias("months"), (F.round(F.sum("pnl"), 3) + 0.0).alias("pnl"), F.round(F.corr("pnl", "market"), 4).alias("correlation"))
    return got.where("months > 2")
