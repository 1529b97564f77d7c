"""Backtests over (entity, date) panels: labels by first passage, event studies with a market model, a portfolio carried from date to date with
its costs, and the weights that combine signals.

An entity's dates, and the dates of a portfolio, are bounded by the calendar; entities aren't. So folds run along dates, inside an entity or
over one row a date, and everything across entities is a partial aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.analytics import deflated_sharpe, normal_quantile
from docquarry.session import materialize

#: Up to so many entities with events are broadcast; beyond it, they are joined by shuffle.
BROADCAST_ENTITIES = 1_000_000


# --- labels -------------------------------------------------------------------------------------------------------------------------
def first_passage(prices: DataFrame, entity: str, day: str, close: str, sigma: str, up: float, down: float, horizon: int) -> DataFrame:
    """Adds ``label`` and ``touch`` to every priced row: 1 if a close of the next ``horizon`` rows first reaches the upper band, -1 the lower,
    0 if the time runs out; ``touch`` is how many rows ahead that was. Bands are multiples of ``sigma``, the daily volatility known at the
    row, of its close. Null without a volatility, or where the rows end before anything is reached."""
    w = Window.partitionBy(entity).orderBy(day)
    ahead = F.collect_list(close).over(w.rowsBetween(1, horizon))
    upper, lower = F.col(close) * (1 + up * F.col(sigma)), F.col(close) * (1 - down * F.col(sigma))
    hits = F.transform("__ahead", lambda c, i: F.when(c >= upper, F.struct((i + 1).alias("at"), F.lit(1).alias("side"))).when(c <= lower, F.struct((i + 1).alias("at"), F.lit(-1).alias("side"))))
    got = prices.withColumn("__ahead", ahead).withColumn("__hit", F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)))
    over = F.size("__ahead") == horizon
    known = F.col(sigma).isNotNull()
    label = F.when(known, F.coalesce(F.col("__hit.side"), F.when(over, F.lit(0))))
    touch = F.when(known, F.coalesce(F.col("__hit.at"), F.when(over, F.lit(horizon))))
    return got.withColumns({"label": label, "touch": touch}).drop("__ahead", "__hit")


# --- event study --------------------------------------------------------------------------------------------------------------------
def abnormal_returns(returns: DataFrame, entity: str, day: str, ret: str, estimation: int, gap: int, window: int, least: int, events: DataFrame | None = None) -> DataFrame:
    """(entity, day, i, n, alpha, beta, car, lo, hi) of every row, or of every row of the entities of ``events``, as if an event took place at it: a market model fitted on the ``estimation``
    rows that end ``gap`` rows before, and the return beyond it summed over the row and the ``window`` after, with its 95 % interval. The
    market is the mean return of all entities on a day, written, since it's one row a day. Fits are differences of sums of products in one window; null where under ``least``
    returns are there to fit, or the market stood still."""
    market = materialize(returns.groupBy(day).agg(F.avg(ret).alias("__m")), "market")
    own = returns if events is None else only_of(returns, events, entity)
    both = own.join(market, day)
    w = Window.partitionBy(entity).orderBy(day)
    fit, held = w.rowsBetween(-gap - estimation, -gap - 1), w.rowsBetween(0, window)
    use = F.col(ret).isNotNull()
    x, y = F.when(use, F.col("__m")), F.col(ret)
    n = F.count(y).over(fit)
    mx, my = F.avg(x).over(fit), F.avg(y).over(fit)
    sxx, syy, sxy = F.var_pop(x).over(fit), F.var_pop(y).over(fit), F.covar_pop(x, y).over(fit)
    got = both.withColumns({"i": F.row_number().over(w), "n": n, "__mx": mx, "__my": my, "__sxx": sxx, "__syy": syy, "__sxy": sxy, "__r": F.sum(y).over(held), "__x": F.sum(x).over(held), "__k": F.count(y).over(held)})
    ready = (F.col("n") >= least) & (F.col("__sxx") > 0)
    beta = F.when(ready, F.col("__sxy") / F.col("__sxx"))
    alpha = F.col("__my") - F.col("beta") * F.col("__mx")
    car = F.col("__r") - F.col("__k") * F.col("alpha") - F.col("beta") * F.col("__x")
    spread = F.sqrt(F.greatest(F.col("__syy") - F.col("beta") * F.col("__sxy"), F.lit(0.0)) * F.col("n") / F.nullif(F.col("n") - 2, F.lit(0)) * F.col("__k"))
    got = got.withColumn("beta", beta).withColumn("alpha", alpha).withColumn("car", car).withColumn("__e", 1.96 * spread)
    return got.select(entity, day, "i", "n", "alpha", "beta", "car", (F.col("car") - F.col("__e")).alias("lo"), (F.col("car") + F.col("__e")).alias("hi"))


def only_of(rows: DataFrame, events: DataFrame, entity: str) -> DataFrame:
    """The rows of entities that ``events`` has."""
    who = events.select(entity).distinct()
    few = who.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    return rows.join(F.broadcast(who) if few else who, entity, "left_semi")


def event_study(events: DataFrame, studied: DataFrame, entity: str, event: str, at: str, day: str) -> DataFrame:
    """(event, n, alpha, beta, car, lo, hi): each event with ``abnormal_returns`` of the first session strictly after its time; nulls where there
    is none. An event's session is the one after the last session known by then."""
    from docquarry.operators.pit import as_of

    sessions = studied.select(entity, F.col(day).cast("timestamp").alias("as_of_ts"), "i")
    spine = events.select(event, entity, F.col(at).cast("timestamp").alias("__at"))
    placed = as_of(spine, sessions, entity, "__at", ["i"], tie="i").select(event, entity, (F.coalesce("i", F.lit(0)) + 1).alias("i"))
    return placed.join(studied.select(entity, "i", "n", "alpha", "beta", "car", "lo", "hi"), [entity, "i"], "left").drop("i", entity)


# --- portfolio ----------------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Book:
    """``target_vol`` a year; ``cap`` on a name; ``participation`` of a name's volume; ``penalty`` on turnover: a weight moves 1 / (1 + penalty)
    of the way to its target. ``most_scale`` bounds the scaling; ``trailing`` dates of profit are scaled by; ``periods`` dates a year."""

    capital: float = 1e6
    target_vol: float = 0.10
    cap: float = 0.05
    participation: float = 0.05
    penalty: float = 0.5
    most_scale: float = 2.0
    trailing: int = 12
    periods: int = 12
    half_spread_bps: float = 5.0
    commission_bps: float = 0.5
    impact: float = 0.1
    borrow_bps: float = 50.0


#: What a signal must reach in either gate.
T1_GATE = {"ic_t_stat_min": 2.0, "top_minus_bottom_t_stat_min": 1.8, "event_study_car_t_stat_min": 2.0, "n_observations_min": 30}
T2_GATE = {"deflated_sharpe_min": 1.0, "ic_mean_min": 0.02, "ic_half_life_min_days": 1.0, "capacity_usd_min": 1_000_000, "sharpe_net_min": 0.7, "sharpe_at_2x_costs_min": 0.3, "max_beta_to_existing": 0.5}


def gate(found: dict[str, Column], limits: dict[str, float]) -> Column:
    """Array of (threshold, found, limit, passes) of each of ``limits``: a ``_min`` is reached, a ``_max`` or ``max_`` isn't exceeded. What isn't known
    doesn't pass."""
    rows = []
    for name, limit in limits.items():
        value = found.get(name, F.lit(None).cast("double")).cast("double")
        good = value >= limit if name.split("_")[0] != "max" and not name.endswith("_max") else F.abs(value) <= limit
        rows.append(F.struct(F.lit(name).alias("threshold"), value.alias("found"), F.lit(float(limit)).alias("limit"), F.coalesce(good, F.lit(False)).alias("passes")))
    return F.array(*rows)


def book_weights(panel: DataFrame, entity: str, date: str, b: Book = Book()) -> DataFrame:
    """Adds ``weight`` and ``before`` (the entity's weight a row earlier). ``panel``: (entity, date, universe, signal, vol, adv, ret).

    Targets are neutral in (date, universe), scaled by volatility and held within the cap and the share of volume; 0 where one of these isn't
    known. A weight is carried on from
    the entity's row before: a fold along its dates, since each depends on the last."""
    neutral = F.col("signal") - F.avg("signal").over(Window.partitionBy(date, "universe"))
    most = F.least(F.lit(b.cap), F.lit(b.participation) * F.col("adv") / F.lit(b.capital))
    ready = F.coalesce(F.col("vol") > 0, F.lit(False)) & F.col("adv").isNotNull() & neutral.isNotNull()
    target = F.greatest(-most, F.least(most, neutral * F.lit(b.target_vol) / F.nullif(F.col("vol"), F.lit(0.0))))
    own = panel.withColumn("__target", F.when(ready, target).otherwise(0.0))
    rows = own.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(date, *[c for c in own.columns if c not in (entity, date)]))).alias("rows"))
    last = lambda acc: F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)).otherwise(F.lit(0.0))
    moved = F.aggregate("rows", F.array().cast("array<double>"), lambda acc, r: F.concat(acc, F.array((r["__target"] + b.penalty * last(acc)) / (1 + b.penalty))))
    each = rows.withColumn("w", moved).select(entity, F.posexplode("rows").alias("p", "r"), "w")
    before = F.when(F.col("p") > 0, F.get("w", F.col("p") - 1)).otherwise(F.lit(0.0))
    return each.select(entity, "r.*", F.get("w", F.col("p")).alias("weight"), before.alias("before")).drop("__target")


def book_dates(weighted: DataFrame, date: str, b: Book = Book(), cost_scale: float = 1.0) -> DataFrame:
    """One row a date: gross, cost and net profit of a unit of capital, turnover, and the scale that the weights were held at.

    The scale follows the trailing profits of the dates before, so that the portfolio's volatility comes to its target. Costs: half the
    spread, market impact by the root of the share of volume, and commission on what is traded; borrowing on shorts. ``cost_scale`` multiplies
    spread and impact."""
    traded = F.abs(F.col("weight") - F.col("before"))
    impact = F.when(F.col("adv") > 0, F.lit(b.impact * 1e4 * cost_scale) * F.sqrt(traded * b.capital / F.col("adv"))).otherwise(0.0)
    bps = F.lit(b.half_spread_bps * cost_scale + b.commission_bps) + impact
    short = F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0) * b.borrow_bps / b.periods
    each = weighted.groupBy(date).agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("raw"), F.sum((traded * bps + short) / 1e4).alias("raw_cost"), F.sum(traded).alias("raw_turnover"))
    past = Window.orderBy(date).rowsBetween(-b.trailing, -1)  # one row a date
    vol = F.stddev_samp("raw").over(past) * F.lit(sqrt(b.periods))
    scale = F.when(vol > 0, F.least(F.lit(b.most_scale), F.lit(b.target_vol) / F.nullif(vol, F.lit(0.0)))).otherwise(1.0)
    got = each.withColumn("scale", scale)
    return got.select(date, "scale", *((F.col("scale") * F.col(c)).alias(n) for c, n in (("raw", "gross"), ("raw_cost", "cost"), ("raw_turnover", "turnover")))).withColumn("net", F.col("gross") - F.col("cost"))


def with_drawdown(dates: DataFrame, date: str) -> DataFrame:
    """Adds ``equity`` (the sum of net profit so far) and ``drawdown`` (how far that is below its highest so far, 0 at the start included)."""
    so_far = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    got = dates.withColumn("equity", F.sum("net").over(so_far))
    return got.withColumn("drawdown", F.greatest(F.max("equity").over(so_far), F.lit(0.0)) - F.col("equity"))


def sharpe(net: Column, periods: int) -> Column:
    return F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0)) * F.lit(sqrt(periods))


def report(dates: DataFrame, date: str, trials: int, b: Book = Book()) -> dict:
    """What a report holds of one backtest, net of costs: dates, Sharpe ratio, its deflated probability given so many trials (by the variance
    that estimates of a ratio have over so many dates), greatest drawdown, turnover a year."""
    r = with_drawdown(dates, date).agg(F.count("*").alias("n"), sharpe(F.col("net"), b.periods).alias("sharpe_net"), F.skewness("net").alias("skew"), F.kurtosis("net").alias("excess"), F.max("drawdown").alias("max_drawdown"), (F.avg("turnover") * b.periods).alias("turnover")).first()
    if not r["n"] or r["sharpe_net"] is None:
        return {"dates": r["n"], "sharpe_net": None, "deflated_sharpe": None, "max_drawdown": r["max_drawdown"], "turnover": r["turnover"]}
    each = r["sharpe_net"] / sqrt(b.periods)
    variance = (1 - r["skew"] * each + (r["excess"] + 2) / 4 * each**2) / max(r["n"] - 1, 1)
    return {"dates": r["n"], "sharpe_net": r["sharpe_net"], "deflated_sharpe": deflated_sharpe(each, r["n"], r["skew"], r["excess"] + 3, trials, max(variance, 0.0)), "max_drawdown": r["max_drawdown"], "turnover": r["turnover"]}


def best_of(trials: int) -> float:
    """What the best of so many trials without skill is expected to reach, in deviations of one."""
    euler = 0.5772156649015329
    return (1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * exp(1))) if trials > 1 else 0.0


def deflated(dates: DataFrame, net: str, trials: int) -> DataFrame:
    """(n, each, z): dates, the Sharpe ratio a date, and its excess over ``best_of`` the trials, in deviations of the estimate. Trials' ratios
    are taken to vary as an estimate over so many dates does."""
    r = dates.agg(F.count("*").alias("n"), (F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0))).alias("each"), F.skewness(net).alias("m3"), F.kurtosis(net).alias("m4"))
    variance = (1 - F.col("m3") * F.col("each") + (F.col("m4") + 2) / 4 * F.col("each") * F.col("each")) / F.nullif(F.col("n") - 1, F.lit(0))
    return r.select("n", "each", (F.col("each") / F.sqrt(F.nullif(F.greatest(variance, F.lit(0.0)), F.lit(0.0))) - F.lit(best_of(trials))).alias("z"))


def regimes(dates: DataFrame, market: DataFrame, date: str, b: Book = Book()) -> DataFrame:
    """(regime, dates, sharpe_net) over four: ``high_vol`` and ``low_vol`` by whether the market's trailing volatility is above its median,
    ``trending`` and ``reverting`` by whether its return continues that of the date before. A date is in one of each two. ``market``: (date, m)."""
    w = Window.orderBy(date)
    vol, was = F.stddev_samp("m").over(w.rowsBetween(-b.trailing, -1)), F.lag("m").over(w)
    seen = market.withColumns({"vol": vol, "was": was})
    middle = seen.agg(F.percentile("vol", 0.5)).first()[0]
    calm = F.when(F.col("vol").isNotNull(), F.when(F.col("vol") > F.lit(middle), "high_vol").otherwise("low_vol"))
    way = F.when(F.col("was").isNotNull(), F.when(F.col("m") * F.col("was") > 0, "trending").otherwise("reverting"))
    each = dates.join(seen.select(date, F.explode(F.array_compact(F.array(calm, way))).alias("regime")), date)
    return each.groupBy("regime").agg(F.count("*").alias("dates"), sharpe(F.col("net"), b.periods).alias("sharpe_net"))


# --- combining signals --------------------------------------------------------------------------------------------------------------
def moments(panel: DataFrame, signals: list[str]) -> dict:
    """(n, correlations, fourth) of standardised ``signals``, over the rows that have all of them: two partial aggregates, whatever the rows.
    ``fourth`` is the mean fourth power of a row's length."""
    full = panel.where(" and ".join(f"`{s}` is not null" for s in signals))
    r = full.agg(F.count("*").alias("n"), *(f(s).alias(f"{k}_{s}") for s in signals for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    z = {s: (F.col(s) - F.lit(r[f"m_{s}"])) / F.lit(r[f"s_{s}"] or 1.0) for s in signals}
    length = sum((z[s] * z[s] for s in signals), F.lit(0.0))
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i:]]
    g = full.agg(F.avg(length * length).alias("fourth"), *(F.avg(z[a] * z[b]).alias(f"{a}|{b}") for a, b in pairs)).first()
    c = np.array([[g[f"{a}|{b}"] if (a, b) in pairs else g[f"{b}|{a}"] for b in signals] for a in signals], float) if r["n"] else np.eye(len(signals))
    return {"n": r["n"], "correlations": c, "fourth": g["fourth"] or 0.0}


def shrunk(n: int, correlations: np.ndarray, fourth: float) -> np.ndarray:
    """Ledoit and Wolf's estimate from moments alone: the matrix drawn towards its scaled identity by the share of its distance from that which
    the sample's own noise explains. The noise, mean squared distance of a row's product from the matrix, is the fourth moment less the
    matrix's square."""
    p = len(correlations)
    middle = np.trace(correlations) / p * np.eye(p)
    far = ((correlations - middle) ** 2).sum() / p
    noise = min((fourth - (correlations**2).sum()) / n / p, far) if n else 0.0
    share = noise / far if far > 0 else 0.0
    return share * middle + (1 - share) * correlations


def signal_weights(correlations: np.ndarray, ics: list[float]) -> np.ndarray:
    """Weights proportional to the information coefficients, less what signals share; absolute values add up to 1."""
    w = np.linalg.solve(correlations, np.array(ics, float))
    return w / (np.abs(w).sum() or 1.0)
