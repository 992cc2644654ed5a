"""Small fixtures made in the test itself."""

from __future__ import annotations

import datetime as dt
import math
import random

DAY0 = dt.datetime(2020, 1, 1)
BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def random_bars(spark, symbols=("AAA", "BBB", "CCC"), n=150, seed=7, gaps=True):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(n):
            price *= math.exp(rng.gauss(0.0005, 0.02))
            if gaps and rng.random() < 0.1:
                continue
            o = price * (1 + rng.gauss(0, 0.005))
            hi, lo = max(o, price) * (1 + rng.random() * 0.01), min(o, price) * (1 - rng.random() * 0.01)
            rows.append((s, DAY0 + dt.timedelta(days=i), o, hi, lo, price, float(rng.randint(1, 100))))
    return spark.createDataFrame(rows, BAR_SCHEMA)


def close_to(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
