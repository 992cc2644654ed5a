"""Signal, fills and trades: hand-worked cases, invariants, and both series layouts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barledger.functions.ordered import Lane, drop_borrowed, lay_out, running
from barledger.operators import capital, fills, metrics, signals, trades
from helpers import DAY0, close_to, random_bars

TINY = dict(block_rows=40, slice_rows=8)
STATES = {"_": ("None", 0, 0, 0), "I": ("init", 1, 0, 1), "H": ("held", 0, 0, 1), "E": ("exit", 0, 1, 0)}
LETTER = {"None": "_", "init": "I", "held": "H", "exit": "E"}


def states(spark, **runs):
    rows = [
        (s, DAY0 + dt.timedelta(days=i), *STATES[c]) for s, text in runs.items() for i, c in enumerate(text)
    ]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, cycle string, enter int, exit int, signal_open int")


def letters(df):
    out = {}
    for r in df.orderBy("symbol", "ts").collect():
        out[r.symbol] = out.get(r.symbol, "") + LETTER[r.cycle]
    return out


@pytest.mark.parametrize("text,k,expected", [
    ("_IHHHE___", 0, "_IHHHE___"), ("_IHHHE___", 1, "__IHHE___"), ("_IHHHE___", 2, "___IHE___"),
    ("_IHHHE___", 3, "____IE___"), ("_IHHHE___", 4, "_________"), ("_IHHHE___", 5, "_________"),
    ("___IE____", 1, "_________"), ("_IHHHHHHE", 3, "____IHHHE"), ("_IHHE_IHE___", 1, "__IHE__IE___"),
    ("_IHHE_IHE___", 2, "___IE_______"), ("IHHEIHE___", 1, "_IHE_IE___"), ("IHHEIHE___", 2, "__IE______"),
])
def test_entry_delay_cases(spark, text, k, expected):
    assert letters(fills.delay_entries(states(spark, S=text), Lane(("symbol",)), k)) == {"S": expected}


def test_entry_delay_keeps_symbols_apart(spark):
    df = states(spark, AAA="_IHHHHE___", BBB="_IHE______", CCC="_IHHE_IHE_")
    out = fills.delay_entries(df, Lane(("symbol",)), 2)
    assert letters(out) == {"AAA": "___IHHE___", "BBB": "__________", "CCC": "___IE_____"}
    entries = out.where("enter = 1").select("signal_open", "cycle").distinct().collect()
    assert [(r.signal_open, r.cycle) for r in entries] == [(0, "init")]
    assert out.where("cycle = 'None' AND (enter <> 0 OR exit <> 0 OR signal_open <> 0)").count() == 0


@pytest.mark.parametrize("rets,expected", [
    ([0.1, 0.1, 0.1], 0), ([0, 0, 0], 0), ([-0.2], -0.2), ([0.1, -0.2], -0.2), ([-0.2, 0.1], -0.2),
    ([0.2, -0.15, 0.2, -0.15], -0.15), ([-0.1, -0.1, -0.1], -0.271), ([0.05], 0), ([-0.05], -0.05),
    ([0.3, -0.02, 0.3], -0.02),
])
def test_intra_trade_drawdown(spark, rets, expected):
    rows = [("S", DAY0 + dt.timedelta(days=i), "held", 0, 1, float(r)) for i, r in enumerate(rets)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, cycle string, enter int, trade_cycle_id long, return_net double")
    out = trades.trade_stats(df, Lane(("symbol",)), ("net",)).first()
    assert close_to(out.max_intra_drawdown_net, expected)


def test_trim_starts_a_new_world(spark):
    rows = [("T", DAY0 + dt.timedelta(days=i), c * 0.999, c * 1.005, c * 0.995, c, 1.0) for i in range(60) for c in [100 * 1.002**i]]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    out, _ = signals.run_trend_signal(bars, 20, DAY0 + dt.timedelta(days=40), timeframe="1d")
    first = out.orderBy("ts").first()
    assert (first.enter, first.trade_direction, first.turnover, first.signal_age, first.cycle) == (1, 1, 1, 1, "init")


def test_flat_signal_until_window_is_full(spark):
    out, _ = signals.run_trend_signal(random_bars(spark, n=15, gaps=False), 20, timeframe="1d")
    assert out.where("signal_close <> 0 OR ma IS NOT NULL").count() == 0


@pytest.mark.parametrize("offset", [0, 2])
def test_blocked_layout_gives_the_same_backtest(spark, offset):
    bars = random_bars(spark, n=400)
    whole, lane = fills.run_backtest(bars, 10, 5.0, offset, timeframe="1d", with_age=True)
    cut, cut_lane = fills.run_backtest(bars, 10, 5.0, offset, timeframe="1d", with_age=True, **TINY)
    assert not lane.blocked and cut_lane.blocked and cut.select("_blk").distinct().count() > 3
    cols = ["cycle", "signal_age", "trade_cycle_id", "return_net", "strategy_equity_net", "strategy_equity_conservative", "ma"]
    a = {(r.symbol, r.ts): r for r in whole.collect()}
    b = {(r.symbol, r.ts): r for r in cut.collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        for c in cols:
            assert close_to(r[c], b[k][c]) if isinstance(r[c], float) else r[c] == b[k][c], (k, c)


def test_blocked_layout_gives_the_same_trades_and_metrics(spark):
    bars = random_bars(spark, n=400)
    whole = fills.run_backtest(bars, 10, 5.0, timeframe="1d")
    cut = fills.run_backtest(bars, 10, 5.0, timeframe="1d", **TINY)
    a = {r.label: r.asDict() for r in trades.trade_stats(*whole).collect()}
    b = {r.label: r.asDict() for r in trades.trade_stats(*cut).collect()}
    assert a.keys() == b.keys()
    for label, row in a.items():
        for c, v in row.items():
            assert close_to(v, b[label][c]) if isinstance(v, float) else v == b[label][c], (label, c)
    for x, y in zip(capital.allocation_summary(*whole).orderBy("symbol").collect(), capital.allocation_summary(*cut).orderBy("symbol").collect()):
        assert all(close_to(float(u), float(v)) for u, v in zip(x[1:], y[1:]))
    rets = metrics.simple_returns(bars, Lane(("symbol",))).select("symbol", "ts", "ret")
    p = metrics.performance(rets, ["symbol"]).orderBy("symbol").collect()
    q = metrics.performance(rets, ["symbol"], **TINY).orderBy("symbol").collect()
    for x, y in zip(p, q):
        assert all(close_to(x[c], y[c]) for c in metrics.METRIC_COLUMNS)
    u = metrics.longest_underwater(rets, ["symbol"]).orderBy("symbol").collect()
    assert u == metrics.longest_underwater(rets, ["symbol"], **TINY).orderBy("symbol").collect()


def test_running_operations_against_python(spark):
    rows = [("S", DAY0 + dt.timedelta(days=i), float((i * 37) % 11) - 5, None if i % 4 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y int")
    laid, lane = lay_out(df, ["symbol"], "ts", "1d", **TINY)
    out = running(drop_borrowed(laid, lane), lane, {
        "s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")),
        "p": ("product", 1 + F.col("x") / 100), "l": ("last", F.col("y")), "n": ("since", F.col("x") == 5),
    }).orderBy("ts").collect()
    total, grow, last, since, xs = 0.0, 1.0, None, 0, []
    for (_, _, x, y), r in zip(rows, out):
        xs.append(x)
        total, grow, last, since = total + x, grow * (1 + x / 100), y if y is not None else last, 0 if x == 5 else since + 1
        assert close_to(r.s, total) and close_to(r.p, grow) and r.hi == max(xs) and r.lo == min(xs) and r.l == last and r.n == since


def test_backtest_invariants(spark):
    bt, lane = fills.run_backtest(random_bars(spark, n=300), 15, 10.0, timeframe="1d")
    assert bt.where("return_conservative > return_mark_to_close + 1e-12").count() == 0
    assert bt.where("return_net > return_mark_to_close").count() == 0
    assert bt.where("cycle = 'None' AND return_mark_to_close <> 0").count() == 0
    balance = bt.groupBy("symbol").agg((F.sum("enter") - F.sum("exit")).alias("d")).collect()
    assert all(r.d in (0, 1) for r in balance)
    stats = trades.trade_stats(bt, lane)
    assert stats.count() == bt.agg(F.sum("enter")).first()[0]


def test_fixed_stake_does_not_depend_on_the_amount(spark):
    bt = fills.run_backtest(random_bars(spark, n=200), 15, 10.0, timeframe="1d")
    a = capital.portfolio_curve(*bt, "net", "fixed_stake", 1000.0).orderBy("ts").collect()
    b = capital.portfolio_curve(*bt, "net", "fixed_stake", 5.0).orderBy("ts").collect()
    assert all(close_to(x.equity, y.equity) for x, y in zip(a, b))


def test_pooled_variants_that_are_equal_agree(spark):
    bt, lane = fills.run_backtest(random_bars(spark, n=300), 15, 10.0, timeframe="1d")
    stats = trades.trade_stats(bt, lane)
    both = stats.withColumn("variant", F.lit("a")).unionByName(stats.withColumn("variant", F.lit("b")))
    rows = trades.pooled_table(both).drop("variant").collect()
    assert rows[0] == rows[1]
    assert close_to(rows[0].median_return, stats.agg(F.percentile("return_net", 0.5)).first()[0])


def test_medians_do_not_depend_on_how_they_are_found(spark):
    bt, lane = fills.run_backtest(random_bars(spark, n=300), 15, 10.0, timeframe="1d")
    stats = trades.trade_stats(bt, lane)
    for make in (trades.trade_summary, trades.quality_table):
        a, b = (
            {(r.symbol, r.asDict().get("method")): r.median_return for r in make(stats, timeframe=width).collect()}
            for width in ("1d", "1m")
        )
        assert a.keys() == b.keys() and all(close_to(a[k], b[k]) for k in a)
    rets = metrics.simple_returns(random_bars(spark, n=120), Lane(("symbol",))).select("symbol", "ts", "ret")
    p = metrics.describe(rets, ["symbol"]).orderBy("symbol").collect()
    q = metrics.describe(rets, ["symbol"], timeframe="1m").orderBy("symbol").collect()
    assert all(close_to(float(x[c]), float(y[c])) for x, y in zip(p, q) for c in ("q25", "q50", "q75", "mean"))
