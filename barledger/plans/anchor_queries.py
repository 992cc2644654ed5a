"""Queries on modelled versus observed values, health checks and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.operators import anchors as an, distributions, health, rebalance as rb
from barledger.plans import tables as t
from barledger.plans.bar_queries import stats
from barledger.plans.metric_queries import week_returns
from barledger.plans.oracle_base import define
from barledger.plans.registry import query
from barledger.plans.rebalance_queries import weekly_signal
from barledger.plans.source_queries import snapshots
from barledger.plans.value_queries import END, book_tables, end_date, month_targets
from barledger.session import settle


def timeline(spark, sf, hidden=False):
    """Book with monthly targets, observed snapshots and the deposit log."""
    p, h, u, _, q, fx = book_tables(spark, sf)
    targets = settle(month_targets(spark, sf))
    seen = settle(snapshots(spark, sf))
    paid = settle(t.deposit(spark, sf))
    points = settle(an.anchor_timeline(p, seen, paid, fx, end_date(), hidden))
    return p, h, u, q, fx, targets, seen, paid, points


def model(spark, sf):
    p, h, _, q, fx, targets, seen, paid, points = timeline(spark, sf, hidden=True)
    sleeves, holdings = an.multi_anchor(p, h, points, targets, q, paid, fx)
    return settle(sleeves), holdings, seen, paid, fx


# AFRICA has no first snapshot; its first deposit lies before the first one it has.
@query("anchor_timeline", "name anchor_date is_hidden", nums="observed", digits=1,
       sql=f"""SELECT name, snap_date AS anchor_date, false AS is_hidden, base_value AS observed FROM snap_values
 UNION ALL SELECT name, DATE '{END}', false, NULL FROM portfolio UNION ALL SELECT name, DATE '2001-05-30', true, NULL FROM portfolio
 UNION ALL SELECT name, min(date), false, arg_min(amount, date) FROM deposit WHERE name = 'AFRICA' GROUP BY name""")
def anchor_timeline(spark, sf):
    return timeline(spark, sf, hidden=True)[-1]


# Walk from boundary to boundary with the shares of every asset and the rebalanced value.
define("anchor_points", f"""SELECT name, snap_date AS day, base_value AS observed FROM snap_values UNION ALL SELECT name, DATE '{END}', NULL FROM portfolio
 UNION ALL SELECT name, DATE '2001-05-30', NULL FROM portfolio UNION ALL SELECT name, min(date), arg_min(amount, date) FROM deposit WHERE name = 'AFRICA' GROUP BY name""")
define("anchor_marks", """SELECT *, lag(day) OVER w AS prev_day, row_number() OVER w AS n, sum(paid) OVER (PARTITION BY name ORDER BY day) AS deposits_cum FROM (
 SELECT name, day, max(a) AS is_anchor, max(c) AS is_change, sum(paid) AS paid FROM (
  SELECT name, day, 1 AS a, 0 AS c, 0.0::DOUBLE AS paid FROM anchor_points
  UNION ALL SELECT DISTINCT t.name, eff_date, 0, 1, 0.0::DOUBLE FROM month_targets t JOIN (SELECT name, min(day) AS lo, max(day) AS hi FROM anchor_points GROUP BY name) s ON s.name = t.name AND eff_date > lo AND eff_date <= hi
   WHERE NOT EXISTS (SELECT 1 FROM anchor_points p WHERE p.name = t.name AND p.day = eff_date)
  UNION ALL SELECT d.name, d.date, 0, 0, CASE WHEN p.currency = 'USD' THEN amount/rate ELSE amount END FROM (SELECT * FROM deposit ASOF JOIN fx ON deposit.date::TIMESTAMP >= fx.ts) d JOIN portfolio p USING (name)
   JOIN (SELECT name, min(day) AS lo, max(day) AS hi FROM anchor_points GROUP BY name) s ON s.name = d.name AND d.date > lo AND d.date <= hi
 ) GROUP BY name, day) WINDOW w AS (PARTITION BY name ORDER BY day)""")
define("anchor_weights", """SELECT m.name, m.day, u.ticker, coalesce(CASE WHEN m.eff IS NULL THEN h.weight ELSE t.weight END, 0) AS weight
 FROM (SELECT name, day, (SELECT max(eff_date) FROM month_targets x WHERE x.name = y.name AND x.eff_date <= y.day) AS eff FROM anchor_marks y) m CROSS JOIN universe u
 LEFT JOIN holding h ON h.name = m.name AND h.ticker = u.ticker LEFT JOIN month_targets t ON t.name = m.name AND t.eff_date = m.eff AND t.ticker = u.ticker""")
define("anchor_growth", """SELECT name, day, product(1 + r) AS growth FROM (
 SELECT m.name, m.day, q.ts, sum(w.weight*q.ret) AS r FROM anchor_marks m JOIN anchor_weights w ON w.name = m.name AND w.day = m.prev_day
 JOIN (SELECT ticker, ts, close/lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS ret FROM quotes) q ON q.ticker = w.ticker AND q.ts::DATE > m.prev_day AND q.ts::DATE <= m.day
 WHERE q.ret IS NOT NULL GROUP BY ALL) GROUP BY name, day""")
define("anchor_lists", """SELECT m.*, 1 - fee_annual*coalesce(date_diff('day', prev_day, m.day), 0)/365.0::DOUBLE AS kept, coalesce(growth, 1) AS growth, w.w, w.px FROM anchor_marks m JOIN portfolio USING (name)
 LEFT JOIN anchor_growth g ON g.name = m.name AND g.day = m.day
 JOIN (SELECT name, day, list(weight ORDER BY ticker) AS w, list(coalesce(close, 0) ORDER BY ticker) AS px FROM (
  SELECT a.*, q.close FROM anchor_weights a ASOF LEFT JOIN quotes q ON a.ticker = q.ticker AND a.day::TIMESTAMP >= q.ts) GROUP BY ALL) w ON w.name = m.name AND w.day = m.day""")
define("anchor_walk", """SELECT * FROM (WITH RECURSIVE r AS (
 SELECT l.name, l.n, l.day, o.observed AS dr, list_transform(w, lambda x, i: CASE WHEN px[i] > 0 THEN o.observed*x/px[i] ELSE 0 END) AS shares
 FROM anchor_lists l JOIN anchor_points o ON o.name = l.name AND o.day = l.day WHERE n = 1
 UNION ALL SELECT l.name, l.n, l.day, r.dr*l.growth*l.kept + l.paid,
  list_transform(l.w, lambda x, i: CASE WHEN l.is_change = 1 THEN CASE WHEN l.px[i] > 0 THEN (l.kept*list_sum(list_transform(r.shares, lambda s, j: s*l.px[j])) + l.paid)*x/l.px[i] ELSE 0 END
   ELSE r.shares[i]*l.kept + CASE WHEN l.px[i] > 0 THEN l.paid*x/l.px[i] ELSE 0 END END)
 FROM r JOIN anchor_lists l ON l.name = r.name AND l.n = r.n + 1) SELECT * FROM r)""")
define("anchor_assets", """SELECT name, day AS anchor_date, ticker, shares*px AS value, px AS price FROM (
 SELECT a.name, a.day, unnest(shares) AS shares, unnest(px) AS px, unnest((SELECT list(ticker ORDER BY ticker) FROM universe)) AS ticker
 FROM anchor_walk a JOIN anchor_lists l ON l.name = a.name AND l.n = a.n WHERE is_anchor = 1) WHERE shares > 0""")
define("anchor_sleeves", """SELECT p.name, p.day AS anchor_date, observed, dr AS model_dr, coalesce(bh, 0) AS model_bh, deposits_cum FROM anchor_points p JOIN anchor_marks m ON m.name = p.name AND m.day = p.day
 JOIN anchor_walk a ON a.name = p.name AND a.day = p.day LEFT JOIN (SELECT name, anchor_date, sum(value) AS bh FROM anchor_assets GROUP BY ALL) b ON b.name = p.name AND b.anchor_date = p.day""")
define("anchor_reconciled", """SELECT *, model - end_value AS gap, (model - end_value)/end_value*100 AS gap_pct FROM (
 SELECT s.name, p.currency, a.sgd_value AS start_value, b.sgd_value AS end_value, model_bh*CASE WHEN p.currency = 'USD' THEN (SELECT arg_max(rate, ts) FROM fx) ELSE 1 END AS model, coalesce(d, 0) AS deposits
 FROM (SELECT name, arg_max(model_bh, anchor_date) AS model_bh FROM anchor_sleeves GROUP BY name) s JOIN portfolio p USING (name)
 LEFT JOIN (SELECT * FROM snap_values WHERE snap_date = DATE '2000-06-30') a USING (name) LEFT JOIN (SELECT * FROM snap_values WHERE snap_date = DATE '2001-06-29') b USING (name)
 LEFT JOIN (SELECT name, sum(amount) AS d FROM deposit GROUP BY name) USING (name))""")


@query("multi_anchor_sleeves", "name anchor_date", nums="model_bh model_dr observed deposits_cum", digits=2,
       sql="SELECT * FROM anchor_sleeves")
def multi_anchor_sleeves(spark, sf):
    return model(spark, sf)[0]


@query("multi_anchor_holdings", "name anchor_date ticker", nums="value price", digits=2, sql="SELECT * FROM anchor_assets")
def multi_anchor_holdings(spark, sf):
    return model(spark, sf)[1]


@query("anchor_segment_returns", "name from_date anchor_date", nums="observed_return bh_return dr_return bh_drift bh_minus_dr", digits=4,
       sql="""SELECT name, from_date, anchor_date, CASE WHEN o0 > 0 THEN (observed - o0 - paid)/o0 END AS observed_return, CASE WHEN b0 > 0 THEN (model_bh - b0 - paid)/b0 END AS bh_return,
 CASE WHEN d0 > 0 THEN (model_dr - d0 - paid)/d0 END AS dr_return, model_bh - observed AS bh_drift, model_bh - model_dr AS bh_minus_dr FROM (
 SELECT *, lag(anchor_date) OVER w AS from_date, lag(observed) OVER w AS o0, lag(model_bh) OVER w AS b0, lag(model_dr) OVER w AS d0, deposits_cum - lag(deposits_cum) OVER w AS paid
 FROM anchor_sleeves WINDOW w AS (PARTITION BY name ORDER BY anchor_date)) WHERE from_date IS NOT NULL""")
def anchor_segment_returns(spark, sf):
    return an.segment_returns(model(spark, sf)[0])


@query("anchor_cumulative_returns", "name", nums="observed_return bh_return dr_return", digits=6,
       sql="""SELECT name, (o - first - o_paid)/first AS observed_return, (b - first - paid)/first AS bh_return, (d - first - paid)/first AS dr_return FROM (
 SELECT name, arg_min(observed, anchor_date) AS first, arg_max(observed, anchor_date) AS o, arg_max(deposits_cum, anchor_date) FILTER (observed IS NOT NULL) AS o_paid,
  arg_max(model_bh, anchor_date) AS b, arg_max(model_dr, anchor_date) AS d, arg_max(deposits_cum, anchor_date) AS paid FROM anchor_sleeves GROUP BY name)""")
def anchor_cumulative_returns(spark, sf):
    return an.cumulative_returns(model(spark, sf)[0])


@query("anchor_asset_gains", "name ticker", nums="price_return gain", digits=4,
       sql="""SELECT name, ticker, r AS price_return, v*r AS gain FROM (
 SELECT name, ticker, arg_min(value, anchor_date) AS v, arg_max(price, anchor_date)/arg_min(price, anchor_date) - 1 AS r FROM anchor_assets GROUP BY ALL)""")
def anchor_asset_gains(spark, sf):
    return an.asset_gains(settle(model(spark, sf)[1]))


def reconciled(spark, sf):
    sleeves, _, seen, paid, fx = model(spark, sf)
    first = seen.where("snap_date = DATE '2000-06-30'")
    last = seen.where("snap_date = DATE '2001-06-29'")
    return settle(an.sleeve_reconcile(sleeves, paid, first, last, fx))


@query("sleeve_reconcile", "name currency status", nums="start_value end_value model deposits gap gap_pct", digits=2,
       sql="""SELECT *, CASE WHEN gap_pct IS NULL THEN 'no app value' WHEN abs(gap_pct) < 0.05::DOUBLE THEN 'exact' WHEN abs(gap_pct) < 0.3::DOUBLE THEN 'ok' WHEN abs(gap_pct) < 1 THEN 'noise' ELSE 'warn' END AS status
 FROM anchor_reconciled""")
def sleeve_reconcile(spark, sf):
    return reconciled(spark, sf)


@query("sleeve_performance", "book_id name", nums="start_value end_value deposits perf perf_pct model model_perf model_perf_pct gap gap_pct", digits=4,
       sql="""WITH l AS (SELECT *, end_value - start_value - deposits AS perf, model - start_value - deposits AS model_perf, CASE WHEN start_value > 0 THEN start_value WHEN deposits > 0 THEN deposits END AS base FROM anchor_reconciled)
SELECT 'current' AS book_id, name, start_value, end_value, deposits, perf, perf/base*100 AS perf_pct, model, model_perf, model_perf/base*100 AS model_perf_pct, gap, gap_pct FROM l
UNION ALL SELECT 'current', NULL, s, e, d, p, p/nullif(s, 0)*100, m, m - s - d, (m - s - d)/nullif(s, 0)*100, g, g/nullif(e, 0)*100 FROM (
 SELECT sum(start_value) AS s, sum(end_value) AS e, sum(deposits) AS d, sum(perf) AS p, sum(model) AS m, sum(gap) AS g FROM l)""")
def sleeve_performance(spark, sf):
    return an.sleeve_performance(reconciled(spark, sf))


@query("observed_performance", "name", nums="start_value end_value deposits perf", digits=1,
       sql="""SELECT *, end_value - start_value - deposits AS perf FROM (SELECT p.name, a.sgd_value AS start_value, b.sgd_value AS end_value, coalesce(d, 0) AS deposits FROM portfolio p
 LEFT JOIN (SELECT * FROM snap_values WHERE snap_date = DATE '2000-06-30') a USING (name) LEFT JOIN (SELECT * FROM snap_values WHERE snap_date = DATE '2001-06-29') b USING (name)
 LEFT JOIN (SELECT name, sum(amount) AS d FROM deposit GROUP BY 1) USING (name))""")
def observed_performance(spark, sf):
    return an.sleeve_performance(reconciled(spark, sf)).where("name IS NOT NULL")


@query("deposit_valuation", "name date", nums="native", digits=5,
       sql="SELECT d.name, d.date, CASE WHEN p.currency = 'USD' THEN amount/rate*(1 - 0.002::DOUBLE) ELSE amount END AS native FROM deposit d JOIN portfolio p USING (name) ASOF JOIN fx ON d.date::TIMESTAMP >= fx.ts")
def deposit_valuation(spark, sf):
    from barledger.operators.asof import as_of_single

    p = t.portfolio(spark, sf).select("name", F.col("currency").alias("own"))
    rows = as_of_single(t.deposit(spark, sf).join(p, "name"), t.fx(spark, sf), "date", "rate", "rate", timeframe="1d")
    return rows.select("name", "date", an.deposit_value(F.col("amount"), F.col("currency"), F.col("own"), F.col("fx_to_base"), F.col("rate")).alias("native"))


@query("new_sleeves", "name ticker statement_date currency", nums="weight value", digits=5,
       sql="""SELECT d.name, m.ticker, d.date AS statement_date, 'SGD' AS currency, weight, weight*amount AS value FROM (SELECT name, min(date) AS date, arg_min(amount, date) AS amount FROM deposit GROUP BY name) d
 JOIN month_targets m ON m.name = d.name AND m.eff_date = date_trunc('month', d.date) WHERE d.name IN ('ASIA', 'EUROPE')""")
def new_sleeves(spark, sf):
    """Two portfolios are taken out of the book and come back through their first deposit."""
    p, _, u, _, _, fx = book_tables(spark, sf)
    kept = p.where("name NOT IN ('ASIA', 'EUROPE')")
    made, held, _ = an.new_sleeves(kept, settle(t.deposit(spark, sf)), settle(snapshots(spark, sf)), settle(month_targets(spark, sf)), u, fx, "current")
    return held.join(made.select("name", "statement_date", "currency"), "name")


@query("residual_deposits", "name date", nums="amount", digits=5,
       sql="SELECT name, date, amount FROM deposit d WHERE name NOT IN ('ASIA', 'EUROPE') OR date > (SELECT min(date) FROM deposit x WHERE x.name = d.name)")
def residual_deposits(spark, sf):
    p, _, u, _, _, fx = book_tables(spark, sf)
    kept = p.where("name NOT IN ('ASIA', 'EUROPE')")
    return an.new_sleeves(kept, settle(t.deposit(spark, sf)), settle(snapshots(spark, sf)), settle(month_targets(spark, sf)), u, fx, "current")[2]


@query("gap_status", "o_orderkey status",
       sql="SELECT o_orderkey, CASE WHEN g IS NULL THEN 'no app value' WHEN g < 0.05::DOUBLE THEN 'exact' WHEN g < 0.3::DOUBLE THEN 'ok' WHEN g < 1 THEN 'noise' ELSE 'warn' END AS status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN abs(o_totalprice/100000 - 2) END AS g FROM orders)")
def gap_status(spark, sf):
    gap = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 100000 - 2)
    return t.table(spark, sf, "orders").select("o_orderkey", an.gap_status(gap).alias("status"))


@query("book_health", "rule level items", "n",
       sql=f"""SELECT 'untagged role' AS rule, 'warn' AS level, 1 AS n, 'AFRICA' AS items UNION ALL
SELECT 'unknown ticker', 'err', count(*), string_agg(name || '/' || ticker, ', ' ORDER BY name) FROM holding WHERE ticker = '5-LOW' HAVING count(*) > 0
UNION ALL SELECT 'no target', 'warn', 1, 'ASIA'
UNION ALL SELECT 'deposits', 'ok', count(*), string_agg(name, ', ' ORDER BY name) FROM (SELECT DISTINCT name FROM deposit WHERE name <> 'AFRICA') HAVING count(*) > 0
UNION ALL SELECT 'no first value', 'warn', 1, 'AFRICA' WHERE 'AFRICA' NOT IN (SELECT name FROM deposit)
UNION ALL SELECT 'target sum', 'warn', count(*), string_agg(name || ' ' || eff_date || ' ' || printf('%.4f', s), ', ' ORDER BY name, eff_date) FROM (SELECT name, eff_date, sum(weight*1.01::DOUBLE) AS s FROM month_targets WHERE name = 'EUROPE' GROUP BY ALL) HAVING count(*) > 0
UNION ALL SELECT 'stale rate', 'warn', 1, max(ts)::DATE::VARCHAR FROM fx HAVING date_diff('day', max(ts)::DATE, DATE '2002-06-30') > 3""")
def book_health(spark, sf):
    p, h, u, _, _, fx = book_tables(spark, sf)
    roles = p.where("name <> 'AFRICA'").select("name")
    off = F.when(F.col("name") == "EUROPE", F.col("weight") * 1.01).otherwise(F.col("weight"))
    targets = settle(month_targets(spark, sf).where("name <> 'ASIA'").withColumn("weight", off))
    return health.book_health(
        p, h, u.where("ticker <> '5-LOW'"), roles, settle(snapshots(spark, sf)), settle(t.deposit(spark, sf)), targets, fx,
        F.lit("2002-06-30").cast("date"),
    )


@query("top_deposits", "name", nums="amount", digits=5, sql="SELECT name, sum(amount) AS amount FROM deposit GROUP BY 1 ORDER BY abs(sum(amount)) DESC, name LIMIT 3")
def top_deposits(spark, sf):
    return health.top_deposits(t.deposit(spark, sf), 3)


HIST_SQL = """SELECT {key}, b AS bin, lo + b*w AS bin_from, n, n/(tot*w) AS density, exp(-pow((lo + (b + 0.5::DOUBLE)*w - mu)/sd, 2)/2)/(sd*sqrt(2*pi())) AS normal_density FROM (
 SELECT {key}, least(coalesce(floor((x - lo)/nullif(w, 0)), 0), {bins} - 1)::INT AS b, lo, w, tot, mu, sd, count(*) AS n FROM (SELECT {key}, x, lo, (hi - lo)/{bins} AS w, tot, mu, sd FROM ({src}) JOIN (
  SELECT {key}, min(x) AS lo, max(x) AS hi, count(x) AS tot, avg(x) AS mu, stddev_samp(x) AS sd FROM ({src}) GROUP BY {key}) USING ({key}) WHERE x IS NOT NULL) GROUP BY ALL)"""


@query("return_histogram", "symbol", "bin n", "bin_from density normal_density", sql=HIST_SQL.format(key="symbol", bins=80, src="SELECT symbol, ret AS x FROM week_ret"))
def return_histogram(spark, sf):
    return distributions.histogram(week_returns(spark, sf), ["symbol"], "ret")


@query("win_loss_histogram", "symbol side", "bin n", "bin_from density normal_density",
       sql=HIST_SQL.format(key="symbol, side", bins=8, src="SELECT symbol, CASE WHEN return_net > 0 THEN 'win' ELSE 'loss' END AS side, return_net AS x FROM d20_stats"))
def win_loss_histogram(spark, sf):
    return distributions.win_loss_histogram(settle(stats(spark, sf)))


@query("top_weights", "ts symbol", nums="weight",
       sql="""WITH w AS (SELECT symbol, ts, 0.2::DOUBLE + extract('year' FROM ts)/100000.0::DOUBLE AS weight FROM w10_sig WHERE signal_open = 1), m AS (SELECT symbol FROM w GROUP BY symbol ORDER BY avg(weight) DESC, symbol LIMIT 2)
SELECT c.ts, m.symbol, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT ts FROM w) c CROSS JOIN m LEFT JOIN w ON w.ts = c.ts AND w.symbol = m.symbol""")
def top_weights(spark, sf):
    w = rb.signal_weights(*weekly_signal(spark, sf)).withColumn("weight", F.lit(0.2) + F.year("ts") / 100000.0)
    return distributions.top_weights(settle(w), n=2)
