"""Signal statistics, labels, splits and portfolio arithmetic over (date, entity) frames."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil, erf, exp, factorial, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_windows(prices: DataFrame, entity: str, day: str, close: str, volume: str) -> DataFrame:
    """Log returns over 1 and 5 rows, 20-row annualised volatility and mean volume; null until a window is full."""
    w = Window.partitionBy(entity).orderBy(day)
    full = w.rowsBetween(-19, 0)
    got = prices.withColumn("ret_1", F.log(F.col(close) / F.lag(close, 1).over(w))).withColumn("ret_5", F.log(F.col(close) / F.lag(close, 5).over(w)))
    vol = F.when(F.count("ret_1").over(full) == 20, F.stddev_samp("ret_1").over(full) * F.sqrt(F.lit(252.0)))
    return got.withColumn("vol_20", vol).withColumn("adv_20", F.when(F.count(volume).over(full) == 20, F.avg(volume).over(full)))


def decayed_index(events: DataFrame, entity: str, at_day: str, days: int, rate: float) -> DataFrame:
    """Per event day: the sum of exp(-rate * age) over the entity's events of the last ``days`` days, by a range window on the day.

    Time is cut into blocks of ``days``, and an event takes part in its own and the next: so a long history of one entity is many
    partitions, and days, taken from a block's start, keep exponentials small."""
    block = F.floor(F.col(at_day) / F.lit(days))
    both = events.withColumn("__b", F.explode(F.array(F.struct(block.alias("at"), F.lit(True).alias("own")), F.struct((block + 1).alias("at"), F.lit(False).alias("own")))))
    age = F.lit(rate) * (F.col(at_day) - (F.col("__b.at") - 1) * days)
    w = Window.partitionBy(entity, "__b.at").orderBy(at_day).rangeBetween(-days, 0)
    return both.withColumn("__e", age).withColumn("index", F.sum(F.exp("__e")).over(w) * F.exp(-F.col("__e"))).where("__b.own").drop("__b", "__e")


def quintiles(df: DataFrame, day: str, value: str, key: str, n: int = 5) -> DataFrame:
    return df.withColumn("bucket", F.ntile(n).over(Window.partitionBy(day).orderBy(value, key)))


def average_rank(value: str, day: str) -> Column:
    """Ranks with ties averaged, within a date: the middle of the rows before and the rows up to the last equal one, both over one window,
    so that a date is sorted once."""
    w = Window.partitionBy(day).orderBy(value)
    return (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null, and no error, where a side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_ic(df: DataFrame, day: str, signal: str, outcome: str, least: int = 1) -> DataFrame:
    """(day, ic): Spearman correlation of signal and outcome on each date of at least ``least`` rows, null where one of them doesn't vary.
    Other columns aren't carried along."""
    ranked = df.select(day, signal, outcome).withColumn("__a", average_rank(signal, day)).select(day, outcome, "__a").withColumn("__b", average_rank(outcome, day))
    return ranked.groupBy(day).agg(correlation("__a", "__b").alias("ic"), F.count("*").alias("__n")).where(F.col("__n") >= least).select(day, "ic")


def forward_returns(prices: DataFrame, entity: str, day: str, close: str, horizons: Sequence[int]) -> DataFrame:
    """Adds ``fwd_<h>`` for each horizon: the log return over the entity's next ``h`` rows, null where there are fewer."""
    w = Window.partitionBy(entity).orderBy(day)
    return prices.withColumns({f"fwd_{h}": F.log(F.lead(close, h).over(w) / F.col(close)) for h in horizons})


def ic_by_horizon(df: DataFrame, day: str, signal: str, outcomes: dict[int, str], least: int = 1) -> DataFrame:
    """(horizon, day, ic): Spearman correlation of the signal with each horizon's outcome, on each date of at least ``least`` rows that have
    both. Dates are shuffled once for all horizons, and the signal is sorted once: its rank for a horizon counts rows with that outcome."""
    at = Window.partitionBy(day).orderBy(signal)
    same = at.rangeBetween(Window.currentRow, Window.currentRow)
    got = df.select(day, signal, *outcomes.values()).where(F.col(signal).isNotNull())
    got = got.withColumns({f"__a_{h}": F.when(F.col(y).isNotNull(), F.count(y).over(at) - (F.count(y).over(same) - 1) / 2) for h, y in outcomes.items()})
    for h, y in outcomes.items():  # nulls come first and move all other ranks of a date alike
        got = got.withColumn(f"__b_{h}", F.when(F.col(y).isNotNull(), average_rank(y, day)))
    daily = got.groupBy(day).agg(*[F.struct(F.lit(h).alias("horizon"), correlation(f"__a_{h}", f"__b_{h}").alias("ic"), F.count(y).alias("n")).alias(f"__{h}") for h, y in outcomes.items()])
    return daily.select(day, F.inline(F.array(*[f"__{h}" for h in outcomes]))).where(F.col("n") >= least).select("horizon", day, "ic")


def triple_barrier(path: DataFrame, key: str, step: str, ret: str, up: float, down: float) -> DataFrame:
    """(key, label): 1 if the upper barrier is touched first, -1 the lower, 0 neither; of both at one step, the lower counts."""
    hits = path.groupBy(key).agg(F.min(F.when(F.col(ret) >= up, F.col(step))).alias("u"), F.min(F.when(F.col(ret) <= down, F.col(step))).alias("d"))
    label = F.when(F.col("u").isNull() & F.col("d").isNull(), 0).when(F.col("d").isNull() | (F.col("u") < F.col("d")), 1).otherwise(-1)
    return hits.select(key, label.alias("label"))


def equal_groups(samples: DataFrame, order: str, groups: int, parts: int = 64) -> DataFrame:
    """Adds ``block`` (1 to ``groups``): equal groups by a numeric ``order``, the first ones larger by one. Ranks are counted inside ranges
    between at most ``parts`` approximate quantiles, whose sizes are summed; only those reach the driver."""
    marks = sorted(set(samples.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.002)))
    part = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= F.col(order).cast("double"))) if marks else F.lit(0)
    cut = samples.withColumn("__part", part)
    sizes = {r[0]: r[1] for r in cut.groupBy("__part").count().collect()}
    before, n = {}, 0
    for k in sorted(sizes):
        before[k], n = n, n + sizes[k]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__part")) if before else F.lit(0)
    rank = start + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    small, more = divmod(n, groups)
    edge = more * (small + 1)
    block = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - edge) / max(small, 1))) + 1
    return cut.withColumn("block", block.cast("int")).drop("__part")


def cpcv_roles(samples: DataFrame, start: str, end: str, groups: int = 6, tests: int = 2, embargo: int = 0) -> DataFrame:
    """(fold, sample columns, role): combinatorial purged splits. Samples are cut into equal ``groups`` by start; each combination of
    ``tests`` groups is tested; training samples that overlap a test group's span, or start within ``embargo`` after it, are purged."""
    spark = samples.sparkSession
    cut = equal_groups(samples, start, groups)
    spans = cut.groupBy("block").agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    folds = spark.createDataFrame([(i, b + 1) for i, c in enumerate(combinations(range(groups), tests)) for b in c], "fold int, block int").join(F.broadcast(spans), "block")
    test = F.broadcast(folds.groupBy("fold").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("t")))
    is_test = F.exists("t", lambda x: x["block"] == F.col("block"))
    purged = F.exists("t", lambda x: (F.col(start) <= x["hi"] + embargo) & (F.col(end) >= x["lo"]))
    return cut.join(test).withColumn("role", F.when(is_test, "test").when(purged, "purged").otherwise("train")).drop("t")


#: Cumulative probabilities of 0 to 7 occurrences at a mean of 1.
POISSON = [sum(exp(-1.0) / factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap_means(df: DataFrame, key: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """(replicate, mean): Poisson bootstrap with weights from digests of (seed, replicate, key), so that reruns and any partitioning agree.
    One row of partial sums a replicate and task is shuffled; samples are not copied out beyond the map side."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), "replicate", F.col(key)).cast("binary"))
    # the first 8 hex digits as a fraction of 2^32 are below a threshold exactly if the digest sorts before the threshold's own digits
    weight = F.lit(8)
    for k, t in reversed(list(enumerate(POISSON))):
        weight = F.when(F.col("__digest") < F.lit(f"{ceil(t * (1 << 32)):08x}"), k).otherwise(weight)
    reps = df.select(key, value).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__digest", digest)
    return reps.withColumn("w", weight).groupBy("replicate").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def bootstrap_interval(df: DataFrame, key: str, value: str, draws: int, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: the mean of ``value`` and the percentile interval of its bootstrap means."""
    cut = (1 - level) / 2
    ends = bootstrap_means(df, key, value, draws, seed).agg(F.percentile("mean", F.lit(cut)).alias("lo"), F.percentile("mean", F.lit(1 - cut)).alias("hi"))
    return df.agg(F.avg(value).alias("mean")).join(ends)


def ic_summary(ics: DataFrame, horizon: str, ic: str) -> DataFrame:
    """(horizon, n, mean, t, decay): of information coefficients by horizon, decay relative to the shortest horizon's mean. Null where the
    divisor is 0."""
    per = ics.groupBy(horizon).agg(F.count(ic).alias("n"), F.avg(ic).alias("mean"), F.try_divide(F.avg(ic), F.stddev_samp(ic) / F.sqrt(F.nullif(F.count(ic), F.lit(0)))).alias("t"))
    base = per.agg(F.min_by("mean", horizon).alias("base"))
    return per.join(F.broadcast(base)).withColumn("decay", F.try_divide("mean", "base")).drop("base")


def welch_t(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """One row: the mean of group ``a`` minus that of ``b``, and Welch's t."""
    side = lambda g: F.when(F.col(group) == g, F.col(value))
    m = df.agg(*[f(side(g)).alias(f"{n}_{s}") for s, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    spread = F.col("mean_a") - F.col("mean_b")
    return m.select(spread.alias("spread"), (spread / F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))).alias("t"))


def portfolio_weights(panel: DataFrame, date: str, signal: str, vol: str, adv: str, universe: str, target_vol: float, cap: float, capital: float, participation: float) -> DataFrame:
    """Adds ``weight``: the signal less its mean in (date, universe), scaled to ``target_vol``, within ``cap`` and within the share
    ``participation`` of the mean volume that ``capital`` may trade. Rows without a volatility or volume have weight 0."""
    neutral = F.col(signal) - F.avg(signal).over(Window.partitionBy(date, universe))
    scaled = neutral * F.lit(target_vol) / F.nullif(F.col(vol), F.lit(0.0))
    most = F.least(F.lit(cap), F.lit(participation) * F.col(adv) / F.lit(capital))
    ready = scaled.isNotNull() & F.col(adv).isNotNull()
    return panel.withColumn("weight", F.when(ready, F.greatest(-most, F.least(most, scaled))).otherwise(0.0))


def normal_quantile(p: float) -> float:
    lo, hi = -12.0, 12.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + erf(mid / sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, trial_variance: float) -> float:
    """Probability that the true Sharpe ratio exceeds what the best of ``trials`` would show by chance."""
    euler = 0.5772156649015329
    chance = sqrt(trial_variance) * ((1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * exp(1)))) if trials > 1 else 0.0
    z = (sharpe - chance) * sqrt(n - 1) / sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2, 1e-12))
    return 0.5 * (1 + erf(z / sqrt(2)))


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def shrunk_weights(returns: np.ndarray, ic: np.ndarray) -> np.ndarray:
    """IC-weighted combination with a covariance shrunk towards its scaled identity."""
    x = returns - returns.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (n * n) / p, d2)
    cov = b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * s if d2 else s
    w = np.linalg.solve(cov, ic)
    return w / np.abs(w).sum()

