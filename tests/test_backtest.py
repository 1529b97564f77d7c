"""Labels, event studies, the portfolio engine, combined signals and dependence against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import analytics, backtest, dependence

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def prices():
    rng = random.Random(1)
    out = []
    for k in range(4):
        close = 100.0
        for i in range([120, 60, 5, 1][k]):
            close *= math.exp(rng.gauss(0, 0.02))
            out.append((k, DAY + dt.timedelta(i), close, None if i < 3 else 0.02))
    return out


@pytest.mark.parametrize("horizon", [1, 7, 200])
def test_first_passage(spark, prices, horizon):
    df = spark.createDataFrame(prices, "k int, day date, close double, sigma double").repartition(3)
    got = {(r["k"], r["day"]): (r["label"], r["touch"]) for r in backtest.first_passage(df, "k", "day", "close", "sigma", 1.5, 1.0, horizon).collect()}
    for k in range(4):
        path = [p for p in prices if p[0] == k]
        for i, (_, day, close, sigma) in enumerate(path):
            want = (None, None)
            if sigma is not None:
                ahead = path[i + 1 : i + 1 + horizon]
                hit = next(((1 if c >= close * (1 + 1.5 * sigma) else -1, j) for j, (_, _, c, _) in enumerate(ahead, 1) if c >= close * (1 + 1.5 * sigma) or c <= close * (1 - 1.0 * sigma)), None)
                want = hit or ((0, horizon) if len(ahead) == horizon else (None, None))
            assert got[k, day] == want


def test_event_studies(spark):
    """A known market model with a known jump: the event's abnormal return is the jump, and sessions are those after the event's time."""
    rng = np.random.default_rng(2)
    market = rng.normal(0, 0.01, 100)
    rows = []
    for k in range(30):
        beta = 0.5 + k / 30
        r = 0.001 + beta * market + rng.normal(0, 1e-6, 100)
        if k == 7:
            r[80:83] += 0.05
        rows += [(k, DAY + dt.timedelta(i), float(v)) for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "k int, day date, r double")
    studied = backtest.abnormal_returns(df, "k", "day", "r", 60, 5, 2, 30)
    events = spark.createDataFrame([(1, 7, DAY + dt.timedelta(79)), (2, 7, DAY + dt.timedelta(40)), (3, 8, DAY + dt.timedelta(79)), (4, 7, DAY + dt.timedelta(10)), (5, 99, DAY), (6, 7, DAY + dt.timedelta(99))], "id int, k int, at date")
    got = {r["id"]: r for r in backtest.event_study(events, studied, "k", "id", "at", "day").collect()}
    assert got[1]["car"] == pytest.approx(0.15, abs=0.01) and got[1]["lo"] < got[1]["car"] < got[1]["hi"] and abs(got[2]["car"]) < 0.01
    assert abs(got[3]["car"]) < 0.01 and got[4]["car"] is None and got[5]["car"] is None and got[6]["car"] is None and len(got) == 6


def test_only_entities_with_events_are_fitted(spark, monkeypatch):
    """Others make the market only; it is that of all."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, DAY + dt.timedelta(i), float(v)) for k in range(12) for i, v in enumerate(rng.normal(0, 0.01, 90))], "k int, day date, r double")
    events = spark.createDataFrame([(1, 3, DAY), (2, 3, DAY), (3, 8, DAY), (4, 99, DAY), (5, None, DAY)], "id int, k int, at date")
    rows = lambda x: sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in x.collect()), key=lambda r: r[:2])
    want = [r for r in rows(backtest.abnormal_returns(df, "k", "day", "r", 60, 5, 2, 30)) if r[0] in (3, 8)]
    assert rows(backtest.abnormal_returns(df, "k", "day", "r", 60, 5, 2, 30, events)) == want and any(r[6] is not None for r in want)
    monkeypatch.setattr(backtest, "BROADCAST_ENTITIES", 1)
    assert rows(backtest.abnormal_returns(df, "k", "day", "r", 60, 5, 2, 30, events)) == want


def test_weights_are_carried_from_date_to_date(spark):
    rng = random.Random(3)
    rows = [(k, DAY + dt.timedelta(31 * m), k % 2, rng.gauss(0, 1), rng.choice([None, 0.1, 0.3, 0.0]), rng.choice([1e3, 1e6, None]), rng.gauss(0, 0.1)) for k in range(6) for m in range(20) if rng.random() < 0.8]
    b = backtest.Book(capital=1e5)
    got = backtest.book_weights(spark.createDataFrame(rows, "k int, m date, universe int, signal double, vol double, adv double, ret double").repartition(3), "k", "m", b)
    weights = {(r["k"], r["m"]): (r["weight"], r["before"]) for r in got.collect()}
    mean = {}
    for _, m, u, s, *_ in rows:
        mean.setdefault((m, u), []).append(s)
    raw, cost, traded = {}, {}, {}
    for k in range(6):
        last = 0.0
        for _, m, u, s, vol, adv, ret in sorted(r for r in rows if r[0] == k):
            neutral = s - sum(mean[m, u]) / len(mean[m, u])
            target = 0.0
            if vol and adv is not None:
                most = min(b.cap, b.participation * adv / b.capital)
                target = max(-most, min(most, neutral * b.target_vol / vol))
            w = (target + b.penalty * last) / (1 + b.penalty)
            assert weights[k, m] == pytest.approx((w, last), abs=1e-12)
            move = abs(w - last)
            bps = b.half_spread_bps + b.commission_bps + (b.impact * 1e4 * math.sqrt(move * b.capital / adv) if adv else 0)
            raw[m] = raw.get(m, 0) + w * ret
            cost[m] = cost.get(m, 0) + (move * bps + max(-w, 0) * b.borrow_bps / b.periods) / 1e4
            traded[m] = traded.get(m, 0) + move
            last = w
    dates = backtest.with_drawdown(backtest.book_dates(got, "m", b), "m")
    past, equity, top = [], 0.0, 0.0
    for r in sorted(dates.collect(), key=lambda r: r["m"]):
        vol = float(np.std(past[-b.trailing :], ddof=1)) * math.sqrt(b.periods) if len(past) > 1 else 0
        scale = min(b.most_scale, b.target_vol / vol) if vol else 1.0
        m = r["m"]
        equity += scale * (raw[m] - cost[m])
        top = max(top, equity)
        assert (r["scale"], r["gross"], r["cost"], r["turnover"], r["equity"], r["drawdown"]) == pytest.approx((scale, scale * raw[m], scale * cost[m], scale * traded[m], equity, top - equity), abs=1e-9)
        past.append(raw[m])
    found = backtest.report(dates, "m", 5, b)
    net = np.array([r["net"] for r in dates.collect()])
    assert found["sharpe_net"] == pytest.approx(net.mean() / net.std(ddof=1) * math.sqrt(12)) and 0 <= found["deflated_sharpe"] <= 1 and found["dates"] == len(net)
    z = backtest.deflated(dates, "net", 5).first()["z"]
    assert 0.5 * (1 + math.erf(z / math.sqrt(2))) == pytest.approx(found["deflated_sharpe"], abs=1e-9)


def test_gates_know_their_directions(spark):
    got = spark.range(1).select(F.inline(backtest.gate({"sharpe_net_min": F.lit(0.7), "max_beta_to_existing": F.lit(-0.6), "ic_mean_min": F.lit(0.019)}, backtest.T2_GATE))).collect()
    assert {r["threshold"]: r["passes"] for r in got} == {k: k == "sharpe_net_min" for k in backtest.T2_GATE}


def test_shrinkage_from_moments(spark):
    """The estimate from sums is the one from all rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([(*map(float, r), i) for i, r in enumerate(x)] + [(None, 1.0, 1.0, -1)], "a double, b double, c double, i int")
    m = backtest.moments(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    s = z.T @ z / len(z)
    far = ((s - np.eye(3)) ** 2).sum() / 3
    noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / len(z) ** 2 / 3, far)
    assert m["n"] == 200 and np.allclose(m["correlations"], s) and np.allclose(backtest.shrunk(m["n"], m["correlations"], m["fourth"]), noise / far * np.eye(3) + (1 - noise / far) * s)
    w = backtest.signal_weights(np.eye(2), [0.1, -0.3])
    assert w.tolist() == pytest.approx([0.25, -0.75])


def plain_information(a, b, k):
    n = len(a)
    if n <= k:
        return None
    dx, dy = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
    far = np.partition(np.maximum(dx, dy) + np.diag(np.full(n, np.inf)), k - 1, axis=1)[:, k - 1]
    nx, ny = (dx < far[:, None]).sum(1) - 1, (dy < far[:, None]).sum(1) - 1
    d = analytics.digamma
    return max(0.0, float(d(np.array([float(k)]))[0] + d(np.array([float(n)]))[0] - np.mean(d(np.maximum(nx, 0) + 1.0) + d(np.maximum(ny, 0) + 1.0))))


def test_information_is_that_of_all_pairs(spark):
    """Groups of several sizes, ties in both coordinates, one value that half of a group has; blocks far smaller than groups."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, n in (("a", 300), ("b", 3), ("c", 4), ("d", 500), (None, 120)):
        x = rng.normal(size=n)
        y = 0.7 * x + rng.normal(size=n)
        if g == "d":
            x, y = np.round(x, 1), np.round(y, 1)
        if g is None:
            x[:60] = 0.0
        want[g] = plain_information(x, y, 3)
        rows += [(g, float(u), float(v)) for u, v in zip(x, y)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", math.nan, 1.0), ("e", None, None)], "g string, x double, y double").repartition(3)
    got = {r["g"]: (r["n"], r["mi"]) for r in dependence.mutual_information(df, "g", "x", "y", 3, dependence.DependenceParams(block=16, sorted_block=32, strips=8)).collect()}
    assert set(got) == set(want) and got["a"][0] == 300
    for g, v in want.items():
        assert got[g][1] is None if v is None else got[g][1] == pytest.approx(v, abs=1e-9)
