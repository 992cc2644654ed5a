"""Queries over several books at once: scenario edits and their deltas against the current book."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.operators import book as bk, performance, returns as rt, risk, scenario as sc
from barledger.plans import tables as t
from barledger.plans.book_queries import ticker_returns
from barledger.plans.metric_queries import metrics_sql, periods_sql
from barledger.plans.oracle_base import define
from barledger.plans.registry import query
from barledger.session import settle

BASE = "current"
EQUAL = {"1-URGENT": 0.5, "2-HIGH": 0.1, "3-MEDIUM": 0.1, "4-NOT SPECIFIED": 0.1, "5-LOW": 0.2}


MOVES = [
    ("drop", "drop", "AFRICA"), ("shift", "shift", "AFRICA", "EUROPE"),
    ("merge", "merge", "MIDDLE EAST", "SOUTH", 0), ("merge", "merge", "AFRICA", "SOUTH", 1),
]


def all_books(spark, sf) -> sc.Book:
    held = settle(t.holding(spark, sf))
    current = sc.Book(settle(t.portfolio(spark, sf, held)), held)
    edited = sc.apply_edits(current, sc.edit_tables(spark, MOVES, {("weights", "EUROPE"): EQUAL}))
    both = sc.union_books([sc.Book(current.portfolio.withColumn("changed", F.lit(False)), held), edited])
    return sc.Book(settle(both.portfolio), settle(both.holding))


def diagnostics(spark, sf):
    """Books, values and the returns panel of every scenario, each settled once."""
    books = all_books(spark, sf)
    values = settle(bk.portfolio_values(books.portfolio, bk.book_fx(books.portfolio)))
    returns, fx = settle(ticker_returns(spark, sf)), t.fx(spark, sf)
    panel = sc.shared_panel(books.portfolio, lambda own: rt.returns_panel(own, books.holding, returns, fx, "1w"), BASE)
    return books, values, settle(panel)


define("sc_holding", """SELECT 'current' AS book_id, name, ticker, weight FROM holding
UNION ALL SELECT 'drop', name, ticker, weight FROM holding WHERE name <> 'AFRICA'
UNION ALL SELECT 'shift', name, ticker, weight FROM holding WHERE name <> 'AFRICA'
UNION ALL SELECT 'weights', name, ticker, CASE WHEN name = 'EUROPE' THEN CASE ticker WHEN '1-URGENT' THEN 0.5::DOUBLE WHEN '5-LOW' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END ELSE weight END FROM holding
UNION ALL SELECT 'merge', name, ticker, weight FROM holding WHERE name NOT IN ('AFRICA', 'MIDDLE EAST')
UNION ALL SELECT 'merge', 'SOUTH', ticker, sum(weight*total_value)/(SELECT sum(total_value) FROM portfolio WHERE name IN ('AFRICA', 'MIDDLE EAST'))
  FROM holding JOIN portfolio USING (name) WHERE name IN ('AFRICA', 'MIDDLE EAST') GROUP BY ticker""")
define("sc_portfolio", """SELECT 'current' AS book_id, name, ord, currency, fee_annual, total_value FROM portfolio
UNION ALL SELECT 'weights', name, ord, currency, fee_annual, total_value FROM portfolio
UNION ALL SELECT 'drop', name, ord, currency, fee_annual, total_value FROM portfolio WHERE name <> 'AFRICA'
UNION ALL SELECT 'shift', name, ord, currency, fee_annual, total_value + CASE WHEN name = 'EUROPE' THEN (SELECT total_value FROM portfolio WHERE name = 'AFRICA') ELSE 0 END FROM portfolio WHERE name <> 'AFRICA'
UNION ALL SELECT 'merge', name, ord, currency, fee_annual, total_value FROM portfolio WHERE name NOT IN ('AFRICA', 'MIDDLE EAST')
UNION ALL SELECT 'merge', 'SOUTH', 0, 'SGD', 0, sum(total_value) FROM portfolio WHERE name IN ('AFRICA', 'MIDDLE EAST')""")
define("sc_values", "SELECT *, total_value*CASE WHEN currency = 'USD' THEN 1.3::DOUBLE ELSE 1 END AS value_base FROM sc_portfolio")
define("sc_raw", """SELECT book_id, name, ts, sum(weight*ret) - any_value(fee_annual)/252 AS ret, any_value(currency) AS currency
FROM sc_holding JOIN sc_portfolio USING (book_id, name) JOIN week_ret ON symbol = ticker JOIN week_complete USING (ts) GROUP BY book_id, name, ts""")
define("sc_panel", """SELECT book_id, name, ts, CASE WHEN currency = 'USD' THEN (1 + ret)*(1 + coalesce(f/lag(f) OVER w - 1, 0)) - 1 ELSE ret END AS ret FROM (
 SELECT *, coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY book_id, name ORDER BY ts), first_value(rate IGNORE NULLS) OVER (PARTITION BY book_id, name ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f
 FROM sc_raw LEFT JOIN fx USING (ts)) WINDOW w AS (PARTITION BY book_id, name ORDER BY ts)""")
define("sc_ret", """SELECT book_id, ts, sum(ret*value_base)/any_value(tot) AS ret FROM sc_panel JOIN sc_values USING (book_id, name)
 JOIN (SELECT book_id, sum(value_base) AS tot, count(*) AS n FROM sc_values GROUP BY 1) USING (book_id) GROUP BY book_id, ts HAVING count(*) = any_value(n)""")


@query("scenario_holdings", "book_id name ticker", nums="weight", sql="SELECT * FROM sc_holding")
def scenario_holdings(spark, sf):
    return all_books(spark, sf).holding


@query("scenario_portfolios", "book_id name currency", "ord", "total_value fee_annual", digits=2, sql="SELECT * FROM sc_portfolio")
def scenario_portfolios(spark, sf):
    return all_books(spark, sf).portfolio


PERF_SQL = f"""SELECT book_id, sharpe, ann_return, ann_vol, max_drawdown AS max_dd, (SELECT sum(value_base) FROM sc_values v WHERE v.book_id = m.book_id) AS aum FROM ({metrics_sql('SELECT * FROM sc_ret', 'book_id')}) m"""
DELTA_SQL = f"""SELECT p.book_id, p.sharpe - c.sharpe AS sharpe_delta, p.ann_return - c.ann_return AS ann_return_delta, p.ann_vol - c.ann_vol AS ann_vol_delta, p.max_dd - c.max_dd AS max_dd_delta, p.aum - c.aum AS aum_delta
FROM (SELECT * FROM perf WHERE book_id <> 'current') p, (SELECT * FROM perf WHERE book_id = 'current') c"""
DELTAS = "sharpe_delta ann_return_delta ann_vol_delta max_dd_delta aum_delta"


@query("scenario_performance", "book_id", nums=DELTAS, digits=4, sql=f"WITH perf AS ({PERF_SQL}) {DELTA_SQL}")
def scenario_performance(spark, sf):
    _, values, panel = diagnostics(spark, sf)
    return sc.performance_deltas(settle(performance.book_performance(panel, values, timeframe="1w")), BASE)


@query("scenario_portfolio_deltas", "book_id name", nums="sharpe_delta vol_delta max_dd_delta",
       sql=f"""WITH m AS ({metrics_sql("SELECT book_id || '|' || name AS series, ts, ret FROM sc_panel", 'series')}), x AS (SELECT string_split(series, '|')[1] AS book_id, string_split(series, '|')[2] AS name, * FROM m)
SELECT p.book_id, p.name, p.sharpe - c.sharpe AS sharpe_delta, p.ann_vol - c.ann_vol AS vol_delta, p.max_drawdown - c.max_drawdown AS max_dd_delta
FROM x p JOIN x c ON p.name = c.name AND c.book_id = 'current' WHERE p.book_id <> 'current'""")
def scenario_portfolio_deltas(spark, sf):
    _, values, panel = diagnostics(spark, sf)
    return sc.portfolio_deltas(settle(performance.benchmark_comparison(panel, values, timeframe="1w")), BASE)


@query("scenario_exposure", "book_id dimension bucket", nums="cur_weight prop_weight weight_delta",
       sql="""WITH e AS (SELECT book_id, dimension, bucket, sum(weight*total_value) AS value, sum(weight*total_value)/sum(sum(weight*total_value)) OVER (PARTITION BY book_id, dimension) AS weight
 FROM sc_holding JOIN sc_portfolio USING (book_id, name) JOIN universe USING (ticker), LATERAL (VALUES ('asset_class', asset_class), ('region', region), ('sector', coalesce(sector, 'Unspecified'))) d(dimension, bucket) GROUP BY 1, 2, 3)
SELECT p.book_id, dimension, bucket, c.weight AS cur_weight, p.weight AS prop_weight, p.weight - c.weight AS weight_delta FROM e p JOIN e c USING (dimension, bucket) WHERE p.book_id <> 'current' AND c.book_id = 'current'""")
def scenario_exposure(spark, sf):
    books = all_books(spark, sf)
    return sc.exposure_deltas(settle(bk.exposure(books.portfolio, books.holding, t.universe(spark, sf))), BASE)


_PM = ("sharpe", "ann_return", "ann_vol", "max_dd")


@query("scenario_periods", "book_id period", nums=" ".join(f"cur_{m} prop_{m} delta_{m}" for m in _PM),
       sql=f"""WITH p AS ({periods_sql('SELECT * FROM sc_ret', 'book_id')}), ids AS (SELECT DISTINCT book_id FROM p WHERE book_id <> 'current'),
 c AS (SELECT ids.book_id, p.* EXCLUDE (book_id) FROM p, ids WHERE p.book_id = 'current')
SELECT book_id, period, {', '.join(f'c.{m} AS cur_{m}, q.{m} AS prop_{m}, q.{m} - c.{m} AS delta_{m}' for m in _PM)} FROM c FULL JOIN (SELECT * FROM p WHERE book_id <> 'current') q USING (book_id, period)""")
def scenario_periods(spark, sf):
    _, values, panel = diagnostics(spark, sf)
    return sc.period_deltas(settle(performance.book_periods(rt.book_returns(panel, values), timeframe="1w")), BASE)


@query("scenario_tails", "book_id horizon cur_best_date cur_worst_date prop_best_date prop_worst_date",
       nums="cur_best cur_worst prop_best prop_worst delta_best delta_worst",
       sql="""WITH s AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts) AS n FROM sc_ret),
 r AS (SELECT book_id, lab, ts, CASE WHEN count(ret) OVER w = any_value(lim) OVER w THEN 1 END AS ok, ret, lim, n FROM s, (VALUES ('1M', 21), ('3M', 63), ('6M', 126), ('1Y', 252)) v(lab, lim) WHERE n > 1 WINDOW w AS (PARTITION BY book_id, lab ORDER BY ts)),
 c AS (SELECT a.book_id, a.lab, a.ts, a.n, product(1 + b.ret) - 1 AS v FROM r a JOIN s b ON a.book_id = b.book_id AND b.n BETWEEN a.n - a.lim + 1 AND a.n WHERE a.n > a.lim GROUP BY ALL),
 x AS (SELECT book_id, lab, max(v) AS best, min(v) AS worst FROM c GROUP BY book_id, lab),
 e AS (SELECT i.book_id, i.lab AS horizon, best, (SELECT min(ts)::DATE FROM c WHERE c.book_id = x.book_id AND c.lab = x.lab AND c.v = x.best) AS best_date, worst,
   (SELECT min(ts)::DATE FROM c WHERE c.book_id = x.book_id AND c.lab = x.lab AND c.v = x.worst) AS worst_date
   FROM (SELECT DISTINCT book_id, lab FROM sc_ret, (VALUES ('1M'), ('3M'), ('6M'), ('1Y')) v(lab)) i LEFT JOIN x USING (book_id, lab))
SELECT p.book_id, horizon, c.best AS cur_best, c.best_date AS cur_best_date, c.worst AS cur_worst, c.worst_date AS cur_worst_date, p.best AS prop_best, p.best_date AS prop_best_date, p.worst AS prop_worst, p.worst_date AS prop_worst_date,
 p.best - c.best AS delta_best, p.worst - c.worst AS delta_worst FROM e p JOIN e c USING (horizon) WHERE p.book_id <> 'current' AND c.book_id = 'current'""")
def scenario_tails(spark, sf):
    _, values, panel = diagnostics(spark, sf)
    return sc.tail_deltas(settle(performance.book_nav(rt.book_returns(panel, values), "1w")), BASE, "1w")


SC_PAIRS = """SELECT a.book_id, a.name AS name_a, b.name AS name_b, corr(a.ret, b.ret) AS rho FROM sc_panel a JOIN sc_panel b ON a.book_id = b.book_id AND a.ts = b.ts
 JOIN sc_portfolio pa ON pa.book_id = a.book_id AND pa.name = a.name JOIN sc_portfolio pb ON pb.book_id = b.book_id AND pb.name = b.name WHERE pa.ord < pb.ord GROUP BY ALL HAVING count(*) >= 20 AND corr(a.ret, b.ret) >= 0.85"""
LIFE_SQL = f"""WITH pr AS ({SC_PAIRS}), k AS (SELECT book_id, least(name_a, name_b) AS pair_a, greatest(name_a, name_b) AS pair_b, rho FROM pr),
 c AS (SELECT i.book_id, pair_a, pair_b, rho FROM k, (SELECT DISTINCT book_id FROM sc_portfolio WHERE book_id <> 'current') i WHERE k.book_id = 'current')
SELECT book_id, pair_a, pair_b, c.rho AS cur_rho, q.rho AS prop_rho, CASE WHEN c.rho IS NULL THEN 'appeared' WHEN q.rho IS NULL THEN 'disappeared' ELSE 'persisted' END AS status
FROM c FULL JOIN (SELECT * FROM k WHERE book_id <> 'current') q USING (book_id, pair_a, pair_b)"""


def redundancy(books, panel):
    pairs = settle(risk.redundancy_pairs(risk.correlations(panel, timeframe="1w"), books.portfolio))
    return sc.redundancy_deltas(pairs, books.portfolio, BASE)


@query("scenario_redundancy", "book_id pair_a pair_b status", nums="cur_rho prop_rho", sql=LIFE_SQL)
def scenario_redundancy(spark, sf):
    books, _, panel = diagnostics(spark, sf)
    return redundancy(books, panel)


@query("scenario_leaderboard", "book_id", "n_appeared n_disappeared", DELTAS, digits=4,
       sql=f"""WITH perf AS ({PERF_SQL}), life AS ({LIFE_SQL}), d AS ({DELTA_SQL})
SELECT d.*, (SELECT count(*) FROM life l WHERE l.book_id = d.book_id AND status = 'appeared') AS n_appeared, (SELECT count(*) FROM life l WHERE l.book_id = d.book_id AND status = 'disappeared') AS n_disappeared FROM d""")
def scenario_leaderboard(spark, sf):
    books, values, panel = diagnostics(spark, sf)
    perf = settle(performance.book_performance(panel, values, timeframe="1w"))
    return sc.leaderboard(perf, redundancy(books, panel), BASE)
