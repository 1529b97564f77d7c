"""Labels, event studies, the portfolio engine, its stress tests and the combination of signals over lineitem's prices, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators import analytics
from docquarry.operators import backtest as op
from docquarry.plans.analytics_plans import _PRICE_SQL, _RET_SQL, _prices
from docquarry.plans.common import table
from docquarry.plans.registry import register
from docquarry.session import materialize

S = SparkSession
UP, DOWN, HORIZON = 1.5, 1.0, 10


def _returns(spark: S, d: str) -> DataFrame:
    """(k, day, close, volume, r, sigma): prices with the day's return and its deviation over twenty."""
    w = Window.partitionBy("k").orderBy("day")
    p = _prices(spark, d).withColumn("r", F.round(F.log(F.col("close") / F.lag("close").over(w)), 8))
    full = w.rowsBetween(-19, 0)
    return p.withColumn("sigma", F.round(F.when(F.count("r").over(full) == 20, F.stddev_samp("r").over(full)), 8))


_SIGMA_SQL = f"{_PRICE_SQL}, r0 as (select *, round(ln(close / lag(close) over (partition by k order by day)), 8) as r from px), r1 as (select *, round(case when count(r) over w = 20 then stddev_samp(r) over w end, 8) as sigma, row_number() over (partition by k order by day) as i from r0 window w as (partition by k order by day rows between 19 preceding and current row))"


@register(
    "barrier_labels",
    f"""with {_SIGMA_SQL}, h as (select a.k, a.i, min(b.i) filter (where b.close >= a.close * (1 + {UP} * a.sigma)) - a.i as u, min(b.i) filter (where b.close <= a.close * (1 - {DOWN} * a.sigma)) - a.i as l, count(b.i) as n
 from r1 a left join r1 b on b.k = a.k and b.i between a.i + 1 and a.i + {HORIZON} where a.sigma is not null group by a.k, a.i)
 select r1.k, epoch(day)::bigint as day, case when sigma is null then null when u is null and l is null then case when n = {HORIZON} then 0 end when l is null or u < l then 1 else -1 end::int as label, case when sigma is null then null else coalesce(least(u, l), case when n = {HORIZON} then {HORIZON} end) end::int as touch from r1 left join h on h.k = r1.k and h.i = r1.i""",
)
def barrier_labels(spark: S, d: str) -> DataFrame:
    """Triple barriers of every priced row: which band of its volatility the next closes reach first, and when."""
    got = op.first_passage(_returns(spark, d), "k", "day", "close", "sigma", UP, DOWN, HORIZON)
    return got.select("k", F.unix_timestamp(F.col("day").cast("timestamp")).alias("day"), "label", "touch")


_STUDY_SQL = f"""{_SIGMA_SQL}, mk as (select day, avg(r) as m from r1 group by day), rm as (select r1.*, case when r is not null then m end as x from r1 join mk using (day)),
 fit as (select k, day, i, count(r) over f as n, case when count(r) over f >= 30 then regr_slope(r, x) over f end as beta, regr_intercept(r, x) over f as alpha, regr_syy(r, x) over f as syy, regr_sxy(r, x) over f as sxy, sum(r) over h as sr, sum(x) over h as sx, count(r) over h as c
 from rm window f as (partition by k order by day rows between 65 preceding and 6 preceding), h as (partition by k order by day rows between current row and 5 following)),
 st as (select *, sr - c * alpha - beta * sx as car, 1.96 * sqrt(greatest(syy - beta * sxy, 0) / (n - 2) * c) as e from fit)"""


@register(
    "event_abnormal",
    f"""with {_STUDY_SQL}, p as (select o_orderkey, o_custkey % 100 as k, (select count(*) from r1 where r1.k = o_custkey % 100 and r1.day <= o_orderdate) + 1 as i from orders)
 select o_orderkey, round(beta, 4) + 0.0 as beta, round(case when beta is not null then car end, 5) + 0.0 as car, round(case when beta is not null then car - e end, 4) + 0.0 as lo, round(case when beta is not null then car + e end, 4) + 0.0 as hi from p left join st on st.k = p.k and st.i = p.i""",
)
def event_abnormal(spark: S, d: str) -> DataFrame:
    """An event for every order: the abnormal return of its supplier over the six sessions after it, by a market model of its own."""
    events = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), "o_orderdate")
    studied = materialize(op.abnormal_returns(_returns(spark, d), "k", "day", "r", 60, 5, 5, 30, events), "studied")
    got = op.event_study(events, studied, "k", "o_orderkey", "o_orderdate", "day")
    return got.select("o_orderkey", *((F.round(c, n) + 0.0).alias(c) for c, n in (("beta", 4), ("car", 5), ("lo", 4), ("hi", 4))))


# --- the portfolio ------------------------------------------------------------------------------------------------------------------
BOOK = op.Book()


def _months(spark: S, d: str) -> DataFrame:
    """(k, month, universe, signal, vol, adv, ret): the month's return as the signal, known at its end, and the next month's."""
    m = _prices(spark, d).groupBy("k", F.trunc("day", "month").alias("month")).agg(F.max_by("close", "day").alias("close"), F.avg(F.col("volume") * F.col("close")).alias("adv"))
    w = Window.partitionBy("k").orderBy("month")
    p = m.withColumn("signal", F.round(F.log(F.col("close") / F.lag("close").over(w)), 8)).withColumn("ret", F.round(F.log(F.lead("close").over(w) / F.col("close")), 8))
    six = w.rowsBetween(-5, 0)
    vol = F.round(F.when(F.count("signal").over(six) == 6, F.stddev_samp("signal").over(six) * F.sqrt(F.lit(12.0))), 8)
    return p.withColumn("vol", vol).where("signal is not null").select("k", "month", (F.col("k") % 3).alias("universe"), "signal", "vol", F.round("adv", 4).alias("adv"), "ret")


_MONTHS_SQL = f"""{_PRICE_SQL}, mm as (select k, date_trunc('month', day)::date as month, arg_max(close, day) as close, avg(volume * close) as adv from px group by all),
 pm as (select *, round(ln(close / lag(close) over w), 8) as signal, round(ln(lead(close) over w / close), 8) as ret from mm window w as (partition by k order by month)),
 pv as (select k, month, k % 3 as universe, signal, round(case when count(signal) over v = 6 then stddev_samp(signal) over v * sqrt(12) end, 8) as vol, round(adv, 4) as adv, ret from pm window v as (partition by k order by month rows between 5 preceding and current row)), pq as (select * from pv where signal is not null)"""


def _book_sql(b: op.Book, name: str, scale: float = 1.0) -> str:
    """The engine by recursion over each entity's rows: tables t, w and e of one book, ending in ``name`` (month, scale, gross, cost, turnover, net)."""
    return f"""{name}t as (select *, row_number() over (partition by k order by month) as i, case when vol > 0 and adv is not null then greatest(-least({b.cap}::double, {b.participation}::double * adv / {b.capital}::double), least(least({b.cap}::double, {b.participation}::double * adv / {b.capital}::double), (signal - avg(signal) over (partition by month, universe)) * {b.target_vol}::double / nullif(vol, 0))) else 0 end as target from pq),
 {name}w as (select k, i, target / (1 + {b.penalty}::double) as weight, 0.0::double as before from {name}t where i = 1 union all select n.k, n.i, (n.target + {b.penalty}::double * w.weight) / (1 + {b.penalty}::double), w.weight from {name}w w join {name}t n on n.k = w.k and n.i = w.i + 1),
 {name}e as (select month, sum(weight * coalesce(ret, 0)) as raw, sum(abs(weight - before)) as rt, sum((abs(weight - before) * ({b.half_spread_bps * scale + b.commission_bps}::double + case when adv > 0 then {b.impact * 1e4 * scale}::double * sqrt(abs(weight - before) * {b.capital}::double / adv) else 0 end) + case when weight < 0 then -weight else 0 end * {b.borrow_bps / b.periods}::double) / 1e4) as rc from {name}w join {name}t using (k, i) group by month),
 {name}s as (select *, case when stddev_samp(raw) over (order by month rows between {b.trailing} preceding and 1 preceding) > 0 then least({b.most_scale}::double, {b.target_vol}::double / nullif(stddev_samp(raw) over (order by month rows between {b.trailing} preceding and 1 preceding) * sqrt({b.periods}), 0)) else 1.0 end as scale from {name}e),
 {name} as (select month, scale, scale * raw as gross, scale * rc as cost, scale * rt as turnover, scale * raw - scale * rc as net from {name}s)"""


def _book(spark: S, d: str, b: op.Book = BOOK, scale: float = 1.0) -> DataFrame:
    return op.book_dates(op.book_weights(_months(spark, d), "k", "month", b), "month", b, scale)


_SHARPE = "avg(net) / nullif(stddev_samp(net), 0) * sqrt(12)"


@register("t2_engine", f"with recursive {_MONTHS_SQL}, {_book_sql(BOOK, 'b')}, q as (select *, sum(net) over (order by month) as equity from b) select month, round(scale, 5) as scale, round(gross, 6) + 0.0 as gross, round(cost, 6) as cost, round(turnover, 6) as turnover, round(net, 6) + 0.0 as net, round(greatest(max(equity) over (order by month), 0) - equity, 6) + 0.0 as drawdown from q")
def t2_engine(spark: S, d: str) -> DataFrame:
    """The portfolio month by month: yesterday's weights in today's, trailing volatility in the scale, costs, drawdown."""
    got = op.with_drawdown(_book(spark, d), "month")
    return got.select("month", F.round("scale", 5).alias("scale"), (F.round("gross", 6) + 0.0).alias("gross"), F.round("cost", 6).alias("cost"), F.round("turnover", 6).alias("turnover"), (F.round("net", 6) + 0.0).alias("net"), (F.round("drawdown", 6) + 0.0).alias("drawdown"))


@register("t2_gate", f"with recursive {_MONTHS_SQL}, {_book_sql(BOOK, 'b')}, {_book_sql(BOOK, 'x', 2.0)}, f as (select 'sharpe_net_min' as threshold, (select {_SHARPE} from b) as found, 0.7 as lim union all select 'sharpe_at_2x_costs_min', (select {_SHARPE} from x), 0.3) select threshold, round(found, 4) as found, coalesce(found >= lim, false) as passes from f")
def t2_gate(spark: S, d: str) -> DataFrame:
    """The gate's thresholds that follow from the books alone: Sharpe ratios net of costs, and at twice the costs."""
    one = _book(spark, d).agg(op.sharpe(F.col("net"), 12).alias("a"))
    two = _book(spark, d, scale=2.0).agg(op.sharpe(F.col("net"), 12).alias("b"))
    limits = {k: op.T2_GATE[k] for k in ("sharpe_net_min", "sharpe_at_2x_costs_min")}
    both = one.crossJoin(two)  # one row each
    rows = both.select(F.inline(op.gate({"sharpe_net_min": F.col("a"), "sharpe_at_2x_costs_min": F.col("b")}, limits)))
    return rows.select("threshold", F.round("found", 4).alias("found"), "passes")


TRIALS = 10
_M3, _M4 = "avg((net - (select avg(net) from b)) ** 3) / stddev_pop(net) ** 3", "avg((net - (select avg(net) from b)) ** 4) / stddev_pop(net) ** 4"


@register("deflated_sharpe", f"with recursive {_MONTHS_SQL}, {_book_sql(BOOK, 'b')}, a as (select count(*) as n, avg(net) / stddev_samp(net) as each, {_M3} as m3, {_M4} as m4 from b) select n as months, round(each, 5) as sharpe, round(each / sqrt((1 - m3 * each + (m4 - 1) / 4 * each ** 2) / (n - 1)) - {op.best_of(TRIALS)!r}, 4) as z from a")
def deflated_sharpe(spark: S, d: str) -> DataFrame:
    """By how many deviations the net Sharpe ratio exceeds what the best of ten trials would show by chance."""
    return op.deflated(_book(spark, d), "net", TRIALS).select(F.col("n").alias("months"), F.round("each", 5).alias("sharpe"), F.round("z", 4).alias("z"))


_REGIME_SQL = f"""with recursive {_MONTHS_SQL}, {_book_sql(BOOK, 'b')}, mk as (select month, avg(ret) as m from pq where ret is not null group by month), ms as (select *, stddev_samp(m) over (order by month rows between 12 preceding and 1 preceding) as vol, lag(m) over (order by month) as was from mk),
 g as (select month, case when vol > (select quantile_cont(vol, 0.5) from ms) then 'high_vol' else 'low_vol' end as regime from ms where vol is not null union all select month, case when m * was > 0 then 'trending' else 'reverting' end from ms where was is not null)
 select regime, count(*) as months, round({_SHARPE}, 4) as sharpe_net from b join g using (month) group by regime"""


@register("stress_four_regimes", _REGIME_SQL)
def stress_four_regimes(spark: S, d: str) -> DataFrame:
    market = _months(spark, d).where("ret is not null").groupBy("month").agg(F.avg("ret").alias("m"))
    return op.regimes(_book(spark, d), market, "month", BOOK).select("regime", F.col("dates").alias("months"), F.round("sharpe_net", 4).alias("sharpe_net"))


#: Each free parameter a fifth down and up.
SWEEP = {f"{name}_{word}": replace(BOOK, **{name: getattr(BOOK, name) * by}) for name in ("penalty", "cap", "target_vol", "participation") for word, by in (("down", 0.8), ("up", 1.2))}


@register("stress_sweep", f"with recursive {_MONTHS_SQL}, " + ", ".join(_book_sql(b, f"v{i}") for i, b in enumerate(SWEEP.values())) + " " + " union all ".join(f"select '{name}' as variant, round({_SHARPE}, 4) as sharpe_net from v{i}" for i, name in enumerate(SWEEP)))
def stress_sweep(spark: S, d: str) -> DataFrame:
    """The net Sharpe ratio with each free parameter a fifth less and a fifth more; a gate counts changes of its sign."""
    panel, out = materialize(_months(spark, d), "sweep-panel"), None
    for name, b in SWEEP.items():
        one = op.book_dates(op.book_weights(panel, "k", "month", b), "month", b).agg(F.lit(name).alias("variant"), F.round(op.sharpe(F.col("net"), 12), 4).alias("sharpe_net"))
        out = one if out is None else out.unionByName(one)
    return out.select("variant", "sharpe_net")


# --- combining signals --------------------------------------------------------------------------------------------------------------
SIGNALS = ["momentum", "reversal", "volume"]


def _signals(spark: S, d: str) -> DataFrame:
    """(k, day, month, SIGNALS, y): signals known at the day's close, and the next row's return."""
    w = Window.partitionBy("k").orderBy("day")
    p = _prices(spark, d)
    lag = lambda n: F.lag("close", n).over(w)
    got = p.select("k", "day", F.date_format("day", "yyyy-MM").alias("month"), F.round(F.log(lag(1) / lag(5)), 8).alias("momentum"), F.round(-F.log(F.col("close") / lag(1)), 8).alias("reversal"), F.round(F.log(F.col("volume") / F.lag("volume").over(w)), 8).alias("volume"), F.round(F.log(F.lead("close").over(w) / F.col("close")), 8).alias("y"))
    return got.where(" and ".join(f"{c} is not null" for c in [*SIGNALS, "y"]))


_SIGNALS_SQL = f"{_PRICE_SQL}, s0 as (select k, day, strftime(day, '%Y-%m') as month, round(ln(lag(close, 1) over w / lag(close, 5) over w), 8) as momentum, round(-ln(close / lag(close, 1) over w), 8) as reversal, round(ln(volume / lag(volume) over w), 8) as volume, round(ln(lead(close) over w / close), 8) as y from px window w as (partition by k order by day)), s1 as (select * from s0 where momentum is not null and reversal is not null and volume is not null and y is not null)"
_Z = {s: f"(({s} - (select avg({s}) from s1)) / (select stddev_pop({s}) from s1))" for s in SIGNALS}
_MOMENTS_SQL = f"{_SIGNALS_SQL}, z as (select {', '.join(f'{_Z[s]} as {s}' for s in SIGNALS)} from s1), mo as (select count(*) as n, avg(momentum * reversal) as ab, avg(momentum * volume) as ac, avg(reversal * volume) as bc, avg((momentum ** 2 + reversal ** 2 + volume ** 2) ** 2) as fourth from z)"


@register("combiner_moments", f"with {_MOMENTS_SQL} select n, round(ab, 6) as ab, round(ac, 6) as ac, round(bc, 6) as bc, round(fourth, 3) as fourth from mo")
def combiner_moments(spark: S, d: str) -> DataFrame:
    """Correlations and the fourth moment of the standardised signals, over all rows."""
    p = _signals(spark, d)
    r = p.agg(*(f(s).alias(f"{k}_{s}") for s in SIGNALS for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    a, b, c = ((F.col(s) - F.col(f"m_{s}")) / F.col(f"s_{s}") for s in SIGNALS)
    rows = p.join(F.broadcast(r))  # one row of means
    length = a * a + b * b + c * c
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(a * b), 6).alias("ab"), F.round(F.avg(a * c), 6).alias("ac"), F.round(F.avg(b * c), 6).alias("bc"), F.round(F.avg(length * length), 3).alias("fourth"))


def _rank_sql(c: str) -> str:
    return f"rank() over (partition by month order by {c}) + (count(*) over (partition by month, {c}) - 1) / 2.0"


_ICS_SQL = f"ra as (select month, {', '.join(f'{_rank_sql(c)} as {c}' for c in [*SIGNALS, 'y'])} from s1), mi as (select month, {', '.join(f'corr({s}, y) as {s}' for s in SIGNALS)} from ra group by month having count(*) > 2), ic as (select {', '.join(f'avg({s}) as {s}' for s in SIGNALS)} from mi)"
#: The three equations of the shrunk matrix [[1, a, b], [a, 1, c], [b, c, 1]] solved by determinants.
_SOLVE_SQL = """sh as (select *, ((ab * ab + ac * ac + bc * bc) * 2) / 3 as far, (fourth - 3 - 2 * (ab * ab + ac * ac + bc * bc)) / n / 3 as noise from mo), sk as (select *, 1 - case when far > 0 then least(noise, far) / far else 0 end as keep from sh),
 m as (select ab * keep as a, ac * keep as b, bc * keep as c, momentum as p, reversal as q, volume as r from sk, ic), w as (select p, q, r, p * (1 - c * c) - a * (q - c * r) + b * (q * c - r) as x, (q - c * r) - p * (a - b * c) + b * (a * r - b * q) as y, (r - q * c) - a * (a * r - q * b) + p * (a * c - b) as z from m), t as (select *, abs(x) + abs(y) + abs(z) as whole from w)"""


@register("combiner", f"with {_MOMENTS_SQL}, {_ICS_SQL}, {_SOLVE_SQL} select 'momentum' as signal, round(p, 6) as ic, round(x / whole, 4) as weight from t union all select 'reversal', round(q, 6), round(y / whole, 4) from t union all select 'volume', round(r, 6), round(z / whole, 4) from t")
def combiner(spark: S, d: str) -> DataFrame:
    """Weights of signals that are known at the date: mean information coefficients over months against the shrunk correlations."""
    panel = _signals(spark, d)
    long = panel.select("month", "y", F.inline(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in SIGNALS)))).withColumn("date", F.concat_ws(":", "signal", "month"))
    ics = analytics.rank_ic(long, "date", "x", "y", least=3).groupBy(F.split("date", ":")[0].alias("signal")).agg(F.avg("ic").alias("ic"))
    m = op.moments(panel, SIGNALS)
    inverse = op.signal_weights  # a catalogue of signals: its matrix is small whatever the rows
    found = {r["signal"]: r["ic"] for r in ics.collect()}
    weights = inverse(op.shrunk(m["n"], m["correlations"], m["fourth"]), [found.get(s, 0.0) for s in SIGNALS])
    at = F.create_map(*[F.lit(x) for s, w in zip(SIGNALS, weights) for x in (s, float(w))])
    return ics.select("signal", F.round("ic", 6).alias("ic"), F.round(at[F.col("signal")], 4).alias("weight"))
