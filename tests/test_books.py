"""Book operators: quantiles, pair moments, returns, risk, scenarios, loaders."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barledger.functions.quantiles import exact_quantiles
from barledger.functions import execution
from barledger.functions.gram import pair_moments
from barledger.operators import book, returns as rt, risk, scenario as sc
from barledger.sources import bars as src, book_json, sinks
from helpers import DAY0, close_to, random_bars

ROLE = {"a": ["holding", "custom"], "b": ["holding", "protected"], "c": ["holding", "managed_benchmark"]}


@pytest.fixture(scope="module")
def small_book(spark):
    portfolios = [("current", n, i, dt.date(2020, 6, 30), v, "SGD", ROLE[n], 0.0, None) for i, (n, v) in enumerate([("a", 200.0), ("b", 150.0), ("c", 300.0)])]
    p = spark.createDataFrame(portfolios, "book_id string, name string, ord int, statement_date date, total_value double, currency string, roles array<string>, fee_annual double, statement_fx double")
    w = {"a": (0.7, 0.2, 0.1), "b": (0.6, 0.3, 0.1), "c": (0.5, 0.2, 0.3)}
    total = {"a": 200.0, "b": 150.0, "c": 300.0}
    h = spark.createDataFrame([("current", n, t, x, x * total[n]) for n, ws in w.items() for t, x in zip(("X", "Y", "Z"), ws)], "book_id string, name string, ticker string, weight double, value double")
    return sc.Book(p, h)


@pytest.fixture(scope="module")
def ticker_returns(spark):
    rng = random.Random(3)
    rows = [(DAY0 + dt.timedelta(days=i), t, rng.gauss(0.0005, 0.01)) for i in range(120) for t in ("X", "Y", "Z")]
    return spark.createDataFrame(rows, "ts timestamp_ntz, ticker string, ret double")


def test_exact_quantiles_on_a_skewed_group(spark):
    rng = random.Random(1)
    values = {"hot": [0.0] * 4000 + [rng.gauss(0, 1) for _ in range(3000)], "one": [2.5], "few": [1.0, 2.0, 4.0, 8.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    out = exact_quantiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()
    assert len(out) == 3
    for r in out:
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
            assert close_to(r[name], float(np.quantile(values[r.k], q)))


def test_pair_moments_over_several_tiles(spark, monkeypatch):
    from barledger.functions import gram

    monkeypatch.setattr(gram, "TILE", 32)
    monkeypatch.setattr(gram, "CHUNK_ROWS", 100)
    rng = random.Random(5)
    names = [f"s{i:03d}" for i in range(70)]
    rows = [("b", n, DAY0 + dt.timedelta(days=i * 9), rng.gauss(0, 1)) for n in names for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "book_id string, name string, ts timestamp_ntz, ret double")
    out = {(r.name_a, r.name_b): r for r in risk.correlations(df, 5).collect()}
    assert len(out) == 70 * 69 // 2 and gram.TILE < 70
    by = {n: {t: v for _, m, t, v in rows if m == n} for n in names}
    for a, b in (("s000", "s001"), ("s003", "s069"), ("s064", "s066")):
        days = sorted(by[a].keys() & by[b].keys())
        expected = np.corrcoef([by[a][d] for d in days], [by[b][d] for d in days])[0, 1]
        assert out[a, b].n_obs == len(days) and close_to(out[a, b].rho, float(expected))
    assert pair_moments(df).where("a > b").count() == 0


def test_daily_fee(spark, small_book):
    rets = spark.createDataFrame([(DAY0, t, 0.0) for t in "XYZ"], "ts timestamp_ntz, ticker string, ret double")
    p = small_book.portfolio.withColumn("fee_annual", F.lit(0.0252))
    assert all(close_to(r.ret, -0.0001) for r in rt.portfolio_returns(p, small_book.holding, rets).collect())


def test_gaps_cut_history_and_strict_fails(spark, small_book):
    rows = [(DAY0 + dt.timedelta(days=i), t, None if t == "Y" and i < 2 else 0.01) for i in range(5) for t in "XYZ"]
    rets = spark.createDataFrame(rows, "ts timestamp_ntz, ticker string, ret double")
    one = small_book.portfolio.where("name = 'a'"), small_book.holding.where("name = 'a'")
    assert rt.portfolio_returns(*one, rets).count() == 3
    with pytest.raises(PySparkException):
        rt.portfolio_returns(*one, rets, strict=True).collect()


def test_risk_matches_the_covariance_matrix(spark, small_book, ticker_returns):
    rows = risk.book_holdings(small_book.portfolio, small_book.holding, book.book_fx(small_book.portfolio))
    model = risk.RiskModel(rows, ticker_returns)
    out = {r.ticker: r for r in model.by_ticker().collect()}
    wide = ticker_returns.toPandas().pivot(index="ts", columns="ticker", values="ret")
    cov = wide.cov().to_numpy() * 252
    w = np.array([out[t].weight for t in "XYZ"])
    sigma = float(np.sqrt(w @ cov @ w))
    for i, t in enumerate("XYZ"):
        assert close_to(out[t].contribution, float(w[i] * (cov @ w)[i] / sigma))
        rest = np.where(np.arange(3) == i, 0, w)
        rest = rest / rest.sum()
        assert close_to(out[t].delta_vol, sigma - float(np.sqrt(rest @ cov @ rest)))
    by_portfolio = model.by_portfolio().collect()
    assert close_to(sum(r.contribution for r in by_portfolio), sigma)
    assert close_to(sum(r.pct_total for r in model.by_holding().collect()), 1.0)


def test_protected_is_never_the_candidate(spark, small_book, ticker_returns):
    panel = rt.returns_panel(small_book.portfolio, small_book.holding, ticker_returns)
    pairs = risk.redundancy_pairs(risk.correlations(panel), small_book.portfolio, -1.0).collect()
    assert len(pairs) == 3 and all(r.candidate != "b" for r in pairs)


def test_exposure_weights_sum_to_one(spark, small_book):
    universe = spark.createDataFrame([("X", "Equity", "US", None), ("Y", "Bond", "US", "Gov"), ("Z", "Equity", "EU", "Tech")], "ticker string, asset_class string, region string, sector string")
    out = book.exposure(*small_book, universe)
    assert all(close_to(r.s, 1.0) for r in out.groupBy("dimension").agg(F.sum("weight").alias("s")).collect())
    assert out.where("bucket = 'Unspecified'").count() == 1


def test_scenario_edits(spark, small_book):
    merged = sc.merge_into(small_book, ["a", "b"], "m", "x")
    p = {r.name: r for r in merged.portfolio.collect()}
    assert set(p) == {"m", "c"} and p["m"].total_value == 350.0 and p["m"].ord == 0
    weights = {r.ticker: r.weight for r in merged.holding.where("name = 'm'").collect()}
    assert close_to(weights["X"], (0.7 * 200 + 0.6 * 150) / 350) and close_to(sum(weights.values()), 1.0)
    moved = sc.rebalance_into(small_book, "a", "c", "x")
    assert {r.name: r.total_value for r in moved.portfolio.collect()} == {"b": 150.0, "c": 500.0}
    changed = sc.set_weights(small_book, "a", {"X": 0.2, "Y": 0.2, "Z": 0.6}, "x")
    assert {r.ticker: r.value for r in changed.holding.where("name = 'a'").collect()} == {"X": 40.0, "Y": 40.0, "Z": 120.0}
    assert small_book.holding.where("name = 'a' AND weight = 0.7").count() == 1


@pytest.mark.parametrize("edit", [
    lambda b: sc.drop_portfolio(b, "nope", "x"),
    lambda b: sc.set_weights(b, "a", {"X": 0.5, "Y": 0.2, "Z": 0.2}, "x"),
    lambda b: sc.set_weights(b, "a", {"X": 0.5, "Y": 0.5}, "x"),
    lambda b: sc.set_weights(b, "a", {"X": 0.5, "Y": 0.25, "Z": 0.15, "Q": 0.1}, "x"),
    lambda b: sc.rebalance_into(b, "a", "a", "x"),
    lambda b: sc.merge_into(b, ["a", "b"], "c", "x"),
    lambda b: sc.merge_into(b, [], "c", "x"),
    lambda b: sc.rebalance_into(sc.Book(b.portfolio.withColumn("currency", F.when(F.col("name") == "a", "USD").otherwise("SGD")), b.holding), "a", "b", "x"),
])
def test_bad_scenario_edits(small_book, edit):
    with pytest.raises(sc.ScenarioEditError):
        edit(small_book)


def test_many_scenarios_of_several_edits_in_one_plan(spark, small_book, ticker_returns):
    moves = [(f"drop {n}", "drop", n) for n in "abc"]
    moves += [("two", "shift", "a", "c"), ("two", "shift", "b", "c")]
    moves += [("mix", "merge", "c", "m", 0, ["holding"]), ("mix", "merge", "b", "m", 1), ("mix", "drop", "a")]
    weights = {("two", "c"): {"X": 0.1, "Y": 0.1, "Z": 0.8}, ("tilt", "b"): {"X": 0.0, "Y": 0.5, "Z": 0.5}}
    out = sc.apply_edits(small_book, sc.edit_tables(spark, moves, weights))
    p = {(r.book_id, r.name): r for r in out.portfolio.collect()}
    h = {(r.book_id, r.name, r.ticker): (r.weight, r.value) for r in out.holding.collect()}
    assert {k for k in p if k[0] == "drop b"} == {("drop b", "a"), ("drop b", "c")} and not any(p[k].changed for k in p if k[0].startswith("drop"))
    assert [k[1] for k in p if k[0] == "two"] == ["c"] and p["two", "c"].total_value == 650.0 and p["two", "c"].changed
    assert all(close_to(x, y) for x, y in zip(h["two", "c", "Z"], (0.8, 520.0)))
    assert [k[1] for k in p if k[0] == "mix"] == ["m"] and p["mix", "m"].roles == ["holding"] and p["mix", "m"].ord == 1
    assert close_to(h["mix", "m", "X"][0], (0.5 * 300 + 0.6 * 150) / 450) and p["tilt", "a"].changed is False and p["tilt", "b"].changed
    assert h["tilt", "b", "Y"] == (0.5, 75.0) and h["tilt", "a", "X"] == (0.7, 140.0)

    both = sc.union_books([sc.Book(small_book.portfolio.withColumn("changed", F.lit(False)), small_book.holding), out])
    panel = lambda own: rt.returns_panel(own, both.holding, ticker_returns, timeframe="1d")
    asked = []
    shared = sc.shared_panel(both.portfolio, lambda own: (asked.append(own.count()), panel(own))[1], "current")
    rows = lambda df: sorted((r.book_id, r.name, r.ts, round(r.ret, 12)) for r in df.select("book_id", "name", "ts", "ret").collect())
    assert rows(shared) == rows(panel(both.portfolio)) and asked == [3 + 3]


def test_edits_of_one_scenario_that_contradict(spark, small_book):
    for moves in ([("x", "shift", "a", "b"), ("x", "drop", "b")], [("x", "drop", "a"), ("x", "shift", "a", "b")], [("x", "shift", "a", "nowhere")]):
        with pytest.raises(sc.ScenarioEditError):
            sc.apply_edits(small_book, sc.edit_tables(spark, moves))


def test_equal_books_have_no_deltas(spark, small_book):
    universe = spark.createDataFrame([(t, "Equity", "US", None) for t in "XYZ"], "ticker string, asset_class string, region string, sector string")
    both = sc.union_books([small_book, small_book.renamed("same")])
    deltas = sc.exposure_deltas(book.exposure(*both, universe), "current").collect()
    assert deltas and all(r.weight_delta == 0 and r.value_delta == 0 for r in deltas)


def test_weight_check_fails_the_job(small_book):
    bad = small_book.holding.withColumn("weight", F.col("weight") * 1.1)
    with pytest.raises(PySparkException):
        book.check_weights(bad).collect()


def test_book_json(spark, tmp_path):
    good = '{"statement_date": "2024-09-30", "currency": "SGD", "portfolios": [{"name": "p", "total_value": 100.0, "holdings": [{"ticker": "A", "weight": 0.4, "value": 40.0}, {"old_id": "OLD", "weight": 0.6}]}]}'
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "bad.json").write_text(good.replace("0.4", "0.3"))
    (tmp_path / "lacking.json").write_text(good.replace('"currency": "SGD",', ""))
    p, h = book_json.read_book(spark, str(tmp_path / "good.json"), "old_id", {"OLD": "NEW"})
    assert p.first().total_value == 100.0 and {(r.ticker, r.weight, r.value) for r in h.collect()} == {("A", 0.4, 40.0), ("NEW", 0.6, 0.0)}
    for name in ("bad", "lacking"):
        with pytest.raises(PySparkException):
            book_json.read_book(spark, str(tmp_path / f"{name}.json"), "old_id")[0].collect()


def test_bar_files(spark, tmp_path):
    bars = random_bars(spark, ("AAA", "BBB"), 30)
    sinks.write_frame(bars.where("symbol = 'AAA'").drop("symbol").withColumnRenamed("ts", "Date"), str(tmp_path / "AAA.parquet"))
    one = bars.where("symbol = 'BBB'").drop("symbol").toPandas()
    one.rename(columns={"ts": " Timestamp", "open": "OPEN"}).to_csv(tmp_path / "BBB.csv", index=False)
    one.head(3).rename(columns={"ts": "time"}).to_csv(tmp_path / "AAA.csv", index=False)
    out = src.read_bars(spark, str(tmp_path), ["AAA", "BBB"])
    assert out.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    counts = {r.symbol: r["count"] for r in out.groupBy("symbol").count().collect()}
    assert counts == {r.symbol: r["count"] for r in bars.groupBy("symbol").count().collect()}
    ranged = src.read_bars(spark, str(tmp_path), ["AAA"], DAY0, DAY0 + dt.timedelta(days=9))
    assert ranged.count() == bars.where("symbol = 'AAA'").where(F.col("ts") <= F.lit(DAY0 + dt.timedelta(days=9)).cast("timestamp_ntz")).count()
    with pytest.raises(FileNotFoundError):
        src.read_bars(spark, str(tmp_path), ["AAA", "ZZZ"])


def test_partitioned_sink(spark, tmp_path):
    bars = random_bars(spark, n=20)
    sinks.write_frame(bars, str(tmp_path / "out"), ["symbol"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == bars.count()


def test_bar_files_with_their_own_layouts(spark, tmp_path):
    bar = {"open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 9.0}
    for symbol, kind, header in (("A", "csv", "date open high low close volume"), ("B", "csv", "volume close low high open Timestamp"),
                                 ("C", "parquet", "Date open high low close volume"), ("D", "parquet", "timestamp close low high open volume")):
        value = lambda c: str(DAY0) if c.lower() in ("date", "timestamp") else bar[c]
        row = spark.createDataFrame([tuple(value(c) for c in header.split())], header.split())
        row.coalesce(1).write.format(kind).option("header", True).save(f"{tmp_path}/{symbol}.{kind}")
    rows = src.read_bars(spark, str(tmp_path), list("ABCD")).collect()
    assert sorted(r.symbol for r in rows) == list("ABCD")
    assert all(r.ts == DAY0 and {c: r[c] for c in bar} == bar for r in rows)


def test_bar_without_a_time_fails(spark):
    bad = spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 1.0)], "date timestamp_ntz, open double, high double, low double, close double, volume double")
    with pytest.raises(PySparkException):
        src.normalise_headers(bad).collect()


def test_bars_are_labelled_by_their_start(spark):
    tick = spark.createDataFrame([(DAY0.replace(hour=10, minute=7),)], "ts timestamp_ntz")
    for frame, want in (("5m", (10, 5)), ("15m", (10, 0)), ("30m", (10, 0)), ("4h", (8, 0)), ("1h", (10, 0))):
        slot = tick.select(src.bar_slot(F.col("ts"), frame)).first()[0]
        assert (slot.hour, slot.minute, slot.second, slot.microsecond) == (*want, 0, 0)


def test_zero_volume_counts_as_unknown(spark):
    q, p = F.lit(10.0), F.lit(5.0)
    row = spark.range(1).select(execution.volume_slippage(q, p, F.lit(0.0)).alias("a"), execution.volume_slippage(q, p).alias("b")).first()
    assert row.a == row.b


def test_weights_are_checked_on_holdings_alone(spark):
    raw = spark.createDataFrame([("2020-01-01", "USD", [("p", 10.0, [("X", None, 0.4, 4.0)])])], book_json.BOOK_SCHEMA)
    with pytest.raises(PySparkException):
        book_json.parse_book(raw)[1].select("weight").collect()


def test_unknown_ticker_and_zero_weights(spark, small_book, ticker_returns):
    some = ticker_returns.where("ticker <> 'Y'")
    with pytest.raises(PySparkException, match="no returns for Y"):
        rt.portfolio_returns(small_book.portfolio, small_book.holding, some).collect()
    with pytest.raises(PySparkException):
        rt.returns_panel(small_book.portfolio, small_book.holding, some, strict=True).collect()
    assert rt.returns_panel(small_book.portfolio, small_book.holding, some).count() == 0
    flat = small_book.holding.withColumn("weight", F.when(F.col("name") == "a", 0.0).otherwise(F.col("weight")))
    with pytest.raises(PySparkException, match="sum to zero"):
        rt.portfolio_returns(small_book.portfolio, flat, ticker_returns).collect()
    assert {r.name for r in rt.portfolio_rejects(flat, ticker_returns).collect()} == {"a"}


def test_currency_returns_over_block_borders(spark, small_book, ticker_returns):
    usd = small_book.portfolio.withColumn("currency", F.lit("USD"))
    fx = ticker_returns.select("ts").distinct().withColumn("rate", 1.3 + F.dayofyear("ts") / 1000.0)
    whole = rt.portfolio_returns(usd, small_book.holding, ticker_returns, fx, "1d").orderBy("name", "ts").collect()
    cut = rt.portfolio_returns(usd, small_book.holding, ticker_returns, fx, "1d", block_rows=10, slice_rows=2).orderBy("name", "ts").collect()
    assert [(r.name, r.ts) for r in whole] == [(r.name, r.ts) for r in cut]
    assert all(close_to(a.ret, b.ret) for a, b in zip(whole, cut))


def test_portfolio_without_the_role_is_left_out(spark, small_book, ticker_returns):
    some = small_book.portfolio.withColumn("roles", F.when(F.col("name") == "c", F.array(F.lit("custom"))).otherwise(F.col("roles")))
    assert {r.name for r in rt.returns_panel(some, small_book.holding, ticker_returns).select("name").distinct().collect()} == {"a", "b"}


def test_all_holders_of_a_ticker_are_named(spark):
    names = [f"p{i:03d}" for i in range(150)]
    rows = spark.createDataFrame([("b", n, t, 1 / 150, 1.0) for n in names for t in ("X", "X", "Y")], "book_id string, name string, ticker string, weight double, value double")
    rets = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), t, 0.01 * i) for i in range(5) for t in "XY"], "ts timestamp_ntz, ticker string, ret double")
    out = {r.ticker: r for r in risk.RiskModel(rows, rets).by_ticker().collect()}
    assert all(out[t].portfolios == ", ".join(names) and out[t].n_portfolios == 150 for t in "XY")


def test_moments_of_pairs_are_not_shuffled(spark, monkeypatch):
    from barledger.functions import gram

    monkeypatch.setattr(gram, "TILE", 8)
    monkeypatch.setattr(gram, "CHUNK_ROWS", 100)
    rng = random.Random(8)
    rows = [(b, f"s{i:03d}", DAY0 + dt.timedelta(days=d * 9), rng.gauss(0, 1)) for b in "bc" for i in range(30) for d in range(40) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "book_id string, name string, ts timestamp_ntz, ret double")
    every = risk.correlations(df, 5)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    want = {tuple(r) for r in every.where("rho >= 0.2").collect()}
    assert want == {tuple(r) for r in risk.close_pairs(df, 0.2, 5).collect()} and len(want) > 20
    assert pair_moments(df, least_rho=0.2).count() < every.count() / 2


def test_points_of_books_with_many_tiles_are_not_copied(spark, monkeypatch):
    from barledger.functions import gram

    monkeypatch.setattr(gram, "TILE", 8)
    monkeypatch.setattr(gram, "LARGEST_TILE", 8)
    rng = random.Random(9)
    days = {("wide", i): range(rng.randrange(40), 60) if i % 10 else range(rng.randrange(30)) for i in range(100)}
    days |= {(b, i): range(60) for b in ("small", "alone") for i in range(20 if b == "small" else 1)}
    rows = [(b, f"s{i:03d}", DAY0 + dt.timedelta(days=d), rng.gauss(1, 0.1) if rng.random() < 0.8 else None) for (b, i), own in days.items() for d in own]
    rows += [("wide", "s1000", DAY0, None)]
    df = spark.createDataFrame(rows, "book_id string, name string, ts timestamp_ntz, ret double")
    m = pair_moments(df, "1d")
    plan = m._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].split("MapInArrow")[1]
    assert "explode" not in plan and "Join Inner" in plan
    by = {}
    for b, n, t, v in rows:
        if v is not None:
            by.setdefault((b, n), {})[t] = v
    want = {(*x, y[1]): len(by[x].keys() & by[y].keys()) for x in by for y in by if x[0] == y[0] and x[1] <= y[1]}
    got = m.collect()
    assert {(r.book_id, r.name_a, r.name_b): int(r.n) for r in got} == {k: n for k, n in want.items() if n}
    assert len(got) == len({(r.book_id, r.a, r.b) for r in got}) and all(r.a <= r.b for r in got)
    every = risk.correlations(df, 5, "1d").collect()
    for r in every:
        a, b = by[r.book_id, r.name_a], by[r.book_id, r.name_b]
        both = sorted(a.keys() & b.keys())
        if len(both) >= 5:
            assert close_to(r.rho, float(np.corrcoef([a[t] for t in both], [b[t] for t in both])[0, 1]))
    assert {tuple(r) for r in risk.close_pairs(df, 0.3, 5, "1d").collect()} == {tuple(r) for r in every if r.rho is not None and r.rho >= 0.3}
    monkeypatch.setattr(gram, "TILE_POINTS", 8 * 20)  # series too long for a tile in one row
    long = risk.correlations(df, 5, "1d")
    assert {(r.book_id, r.name_a, r.name_b, r.n_obs) for r in long.collect()} == {(r.book_id, r.name_a, r.name_b, r.n_obs) for r in every}
    assert "Union" not in long._jdf.queryExecution().optimizedPlan().toString()


def exchanged_rows(plan):
    """Rows that the exchanges of an executed plan carry."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(map(exchanged_rows, below))


def test_close_pairs_move_rows_by_series_not_by_tiles(spark, monkeypatch):
    from barledger.functions import gram

    monkeypatch.setattr(gram, "TILE", 8)
    monkeypatch.setattr(gram, "LARGEST_TILE", 8)
    rng = random.Random(10)
    market = [rng.gauss(0, 1) for _ in range(40)]
    series = {f"s{i:03d}": [rng.gauss(0, 1) + (i % 7 == 0) * market[d] for d in range(40)] for i in range(160)}
    df = spark.createDataFrame([("b", n, DAY0 + dt.timedelta(days=d), v) for n, own in series.items() for d, v in enumerate(own)], "book_id string, name string, ts timestamp_ntz, ret double")
    close = risk.close_pairs(df, 0.3, 20, "1d")
    found = {(r.name_a, r.name_b): r.rho for r in close.collect()}
    names, rho = list(series), np.corrcoef(list(series.values()))
    assert found.keys() == {(names[i], names[j]) for i in range(160) for j in range(i + 1, 160) if rho[i, j] >= 0.3}
    assert exchanged_rows(close._jdf.queryExecution().executedPlan()) < 5 * 160  # 20 tiles: copies were 3,200 rows
