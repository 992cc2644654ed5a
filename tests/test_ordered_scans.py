"""Running affine composition and newest rows in both layouts against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barledger.functions.ordered import drop_borrowed, lay_out, newest_rows, running
from helpers import DAY0, close_to


def series(n=90, seed=3):
    rng = random.Random(seed)
    rows = []
    for name in ("a", "b", "c"):
        for i in range(n):
            if rng.random() < 0.8:
                factor = rng.choice([0.0, 1.0, -0.5, 1.02, 0.97, 1.3])
                rows.append((name, DAY0 + dt.timedelta(days=i), factor, rng.uniform(-5, 5)))
    return rows


@pytest.mark.parametrize("layout", [{}, {"block_rows": 12, "slice_rows": 4}])
def test_affine_running(spark, layout):
    rows = series()
    df = spark.createDataFrame(rows, "name string, ts timestamp_ntz, factor double, term double")
    laid, lane = lay_out(df, ["name"], "ts", "1d", **layout)
    out = running(drop_borrowed(laid, lane), lane, {
        "v": ("affine", (F.col("factor"), F.col("term"))), "w": ("affine", (F.lit(1.0), F.col("term"))), "n": ("sum", F.lit(1)),
    })
    got = {(r.name, r.ts): (r.v, r.w, r.n) for r in out.collect()}
    assert len(got) == len(rows)
    for name in ("a", "b", "c"):
        v, w = 0.0, 0.0
        for i, (_, ts, factor, term) in enumerate([r for r in sorted(rows) if r[0] == name], 1):
            v, w = factor * v + term, w + term
            assert close_to(got[name, ts][0], v, 1e-7) and close_to(got[name, ts][1], w, 1e-7) and got[name, ts][2] == i


@pytest.mark.parametrize("n, slice_rows", [(1, 1), (7, 3), (30, 64), (500, 5)])
def test_newest_rows(spark, n, slice_rows):
    rows = series(seed=n)
    df = spark.createDataFrame(rows, "name string, ts timestamp_ntz, factor double, term double")
    got = sorted((r.name, r._nth, r.ts) for r in newest_rows(df, ["name"], n, "1d", slice_rows=slice_rows).collect())
    want = []
    for name in ("a", "b", "c"):
        own = sorted((r[1] for r in rows if r[0] == name), reverse=True)[:n]
        want += [(name, i, ts) for i, ts in enumerate(own, 1)]
    assert got == sorted(want)
    assert newest_rows(df.where("false"), ["name"], n, "1d").count() == 0
