"""Rebalanced NAV and anchor model against plain loops on small fixtures."""

import datetime as dt
import random

import pytest

from barledger.operators import anchors as an, rebalance as rb
from helpers import DAY0, close_to, random_bars


def plain_nav(bars, weights, capital, bps):
    """Loop over bars with dictionaries: drift, return to the weights, pay for what is traded."""
    close = {(r.ts, r.symbol): r.close for r in bars}
    days = sorted({t for t, _ in close})
    nav, held, out = capital, {}, {}
    for before, ts in zip([None, *days], days):
        ret = {s: close[ts, s] / close[before, s] - 1 if (ts, s) in close and (before, s) in close else 0.0 for s in held}
        gross = sum(w * ret[s] for s, w in held.items())
        drift = {s: w * (1 + ret[s]) / (1 + gross) for s, w in held.items()}
        want = {s: w for (t, s), w in weights.items() if t == ts}
        turnover = sum(abs(want.get(s, 0.0) - drift.get(s, 0.0)) for s in want.keys() | drift.keys())
        nav *= (1 + gross) * (1 - turnover * bps / 1e4)
        if held or want:
            out[ts] = nav
        held = want
    return out


@pytest.mark.parametrize("layout", [{}, {"block_rows": 20, "slice_rows": 4}])
def test_held_nav(spark, layout):
    bars = random_bars(spark, n=80)
    rows = bars.collect()
    rng = random.Random(2)
    weights = {v: {(r.ts, r.symbol): rng.choice([0.2, 0.5, 0.1]) for r in rows if rng.random() < 0.6} for v in ("u", "v")}
    wdf = spark.createDataFrame([(v, t, s, w) for v, m in weights.items() for (t, s), w in m.items()], "variant string, ts timestamp_ntz, symbol string, weight double")
    nav = rb.held_nav(bars, wdf, capital=1000.0, timeframe="1d", **layout)
    for v in ("u", "v"):
        expected = plain_nav(rows, weights[v], 1000.0, 5)
        got = {r.ts: r.nav for r in nav.where(f"variant = '{v}'").collect()}
        assert got.keys() == expected.keys()
        assert all(close_to(got[t], expected[t], 1e-8) for t in got)
    assert rb.held_trades(bars, wdf, nav, timeframe="1d").where("abs(change) <= 1e-9").count() == 0


D = dt.date


def plain_anchor_model(opening, own, targets, deposits, anchors, prices, fee):
    """Loop over all dates with per-asset shares; the rebalanced value beside it."""
    def price(t, d):
        known = [p for day, p in prices[t] if day <= d]
        return known[-1] if known else None

    def weights(d):
        past = [x for x in targets if x <= d]
        return targets[max(past)] if past else own

    first, last = anchors[0], anchors[-1]
    assets = sorted(set(own) | {t for w in targets.values() for t in w})
    shares = {t: opening * weights(first).get(t, 0) / price(t, first) for t in assets}
    dr = opening
    changes = {d for d in targets if first < d < last and d not in anchors}
    days = sorted(set(anchors) | changes | {d for d in deposits if first < d <= last})
    out = {first: (opening, opening)}
    for a, b in zip(days, days[1:]):
        w = weights(a)
        moves = sorted({day for t in w for day, _ in prices[t] if a < day <= b})
        for day in moves:
            dr *= 1 + sum(
                w[t] * (price(t, day) / price(t, day - dt.timedelta(days=1)) - 1) for t in w if any(x == day for x, _ in prices[t])
            )
        keep = 1 - fee * (b - a).days / 365
        dr *= keep
        shares = {t: s * keep for t, s in shares.items()}
        paid = deposits.get(b, 0.0)
        dr += paid
        if b in changes:
            total = sum(s * price(t, b) for t, s in shares.items()) + paid
            shares = {t: total * weights(b).get(t, 0) / price(t, b) for t in assets}
        elif paid:
            for t in assets:
                shares[t] += paid * weights(b).get(t, 0) / price(t, b)
        if b in anchors:
            out[b] = (sum(s * price(t, b) for t, s in shares.items()), dr)
    return out


def test_anchor_model(spark):
    rng = random.Random(9)
    prices = {}
    for t in ("X", "Y", "Z"):
        p, series = 100.0, []
        for i in range(0, 120):
            p *= 1 + rng.gauss(0, 0.02)
            if rng.random() < 0.7 or i == 0:
                series.append((D(2020, 1, 1) + dt.timedelta(days=i), p))
        prices[t] = series
    own = {"X": 0.5, "Y": 0.5}
    targets = {D(2020, 2, 1): {"X": 0.2, "Y": 0.3, "Z": 0.5}, D(2020, 3, 1): {"Y": 1.0}, D(2020, 3, 20): {"X": 0.6, "Z": 0.4}}
    deposits = {D(2020, 1, 20): 50.0, D(2020, 2, 10): 70.0, D(2020, 3, 1): 30.0, D(2020, 4, 10): 20.0}
    anchor_days = [D(2020, 1, 10), D(2020, 2, 15), D(2020, 3, 20), D(2020, 4, 10)]
    expected = plain_anchor_model(1000.0, own, targets, deposits, anchor_days, prices, 0.01)

    p = spark.createDataFrame([("k", "P", 0, D(2020, 1, 10), 1000.0, "SGD", ["holding"], 0.01, None)], "book_id string, name string, ord int, statement_date date, total_value double, currency string, roles array<string>, fee_annual double, statement_fx double")
    h = spark.createDataFrame([("k", "P", t, w, w * 1000) for t, w in own.items()], "book_id string, name string, ticker string, weight double, value double")
    tg = spark.createDataFrame([("P", d, t, w) for d, ws in targets.items() for t, w in ws.items()], "name string, eff_date date, ticker string, weight double")
    dep = spark.createDataFrame([("P", d, "SGD", a, None) for d, a in deposits.items()], "name string, date date, currency string, amount double, fx_to_base double")
    px = spark.createDataFrame([(t, dt.datetime(d.year, d.month, d.day), v) for t, s in prices.items() for d, v in s], "ticker string, ts timestamp_ntz, close double")
    fx = spark.createDataFrame([(DAY0, 1.3)], "ts timestamp_ntz, rate double")
    seen = spark.createDataFrame([("P", D(2020, 1, 10), 1000.0, 1000.0), ("P", D(2020, 2, 15), 1100.0, 1100.0), ("P", D(2020, 3, 20), 1200.0, 1200.0)], "name string, snap_date date, base_value double, sgd_value double")
    from pyspark.sql import functions as F

    points = an.anchor_timeline(p, seen, dep, fx, F.lit("2020-04-10"))
    assert sorted(r.anchor_date for r in points.collect()) == anchor_days
    sleeves, assets = an.multi_anchor(p, h, points, tg, px, dep, fx)
    rows = {r.anchor_date: r for r in sleeves.collect()}
    for d, (bh, dr) in expected.items():
        assert close_to(rows[d].model_bh, bh, 1e-8), d
        assert close_to(rows[d].model_dr, dr, 1e-8), d
    assert rows[anchor_days[-1]].deposits_cum == sum(deposits.values())
    total = {r.anchor_date: r.v for r in assets.groupBy("anchor_date").agg(F.sum("value").alias("v")).collect()}
    assert all(close_to(total[d], rows[d].model_bh) for d in anchor_days)
