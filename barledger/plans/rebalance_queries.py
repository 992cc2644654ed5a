"""Queries on execution costs, signal weights and rebalanced NAVs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.functions import execution as ex
from barledger.operators import asof, metrics, rebalance as rb
from barledger.operators.signals import run_trend_signal
from barledger.plans import tables as t
from barledger.plans.oracle_base import define
from barledger.plans.registry import query
from barledger.session import settle


COST_COLUMNS = ("fixed_fill", "volume_bps", "volume_fill", "per_share", "percent", "worst_base")


@query("execution_costs", "l_suppkey", nums=" ".join(COST_COLUMNS), digits=4,
       sql=f"""SELECT l_suppkey, {', '.join(f'sum({c}) AS {c}' for c in COST_COLUMNS)} FROM (SELECT l_suppkey, p*(1 + s*5.0::DOUBLE/10000) AS fixed_fill, bps AS volume_bps, p*(1 + s*bps/10000) AS volume_fill,
 greatest(abs(q)*0.005::DOUBLE, 1) AS per_share, abs(q*p)*0.001::DOUBLE AS percent, CASE WHEN q > 0 THEN p*1.01::DOUBLE WHEN q < 0 THEN p*0.99::DOUBLE ELSE p END AS worst_base FROM (
 SELECT *, 2 + 0.1::DOUBLE*sqrt(abs(q*p)/coalesce(adv, 1000000))*100 AS bps, CASE WHEN q > 0 THEN 1 ELSE -1 END AS s FROM (
  SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice/l_quantity AS p, adv
  FROM lineitem LEFT JOIN (SELECT l_suppkey AS sk, avg(v) AS adv FROM (SELECT l_suppkey, l_shipdate, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1
   HAVING max(l_shipdate) >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY) ON sk = l_suppkey))) GROUP BY l_suppkey""")
def execution_costs(spark, sf):
    """Every line item as a trade at the average daily volume of its supplier, unknown if that has not traded in the last 30 days."""
    items = t.table(spark, sf, "lineitem")
    daily = items.groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_extendedprice").alias("v"))
    alive = items.agg(F.max("l_shipdate")).scalar() - F.expr("INTERVAL 30 DAYS")
    adv = daily.groupBy("l_suppkey").agg(F.avg("v").alias("adv"), F.max("l_shipdate").alias("_last"))
    adv = adv.where(F.col("_last") >= alive).select("l_suppkey", "adv")
    rows = items.join(adv, "l_suppkey", "left").withColumns({
        "q": F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")),
        "p": F.col("l_extendedprice") / F.col("l_quantity"),
    })
    q, p = F.col("q"), F.col("p")
    costs = rows.withColumn("volume_bps", ex.volume_slippage(q, p, F.col("adv"))).withColumns({
        "fixed_fill": ex.fill_price(p, q, ex.fixed_slippage(q, p)),
        "volume_fill": ex.fill_price(p, q, F.col("volume_bps")),
        "per_share": ex.per_share_commission(q, p),
        "percent": ex.percent_commission(q, p),
        "worst_base": ex.fill_base(q, p, high=p * 1.01, low=p * 0.99),
    })
    return costs.groupBy("l_suppkey").agg(*[F.sum(c).alias(c) for c in COST_COLUMNS])


def weekly_signal(spark, sf):
    return run_trend_signal(t.bars_week(spark, sf), 10, timeframe="1w")


@query("signal_weights", "symbol ts", nums="weight",
       sql="SELECT symbol, ts, 1.0::DOUBLE/(SELECT count(DISTINCT symbol) FROM w10_sig) AS weight FROM w10_sig WHERE signal_open = 1")
def signal_weights(spark, sf):
    return rb.signal_weights(*weekly_signal(spark, sf))


@query("signal_weights_asof", "symbol ts", nums="weight",
       sql="""SELECT s.symbol, d.ts, 1.0::DOUBLE/(SELECT count(DISTINCT symbol) FROM w10_sig) AS weight
FROM (SELECT DISTINCT ts FROM bars_day) d ASOF JOIN (SELECT DISTINCT ts FROM w10_sig) p ON d.ts >= p.ts JOIN w10_sig s ON s.ts = p.ts WHERE s.signal_open = 1""")
def signal_weights_asof(spark, sf):
    """Weekly signal asked for on every trading day."""
    signal, lane = weekly_signal(spark, sf)
    return rb.signal_weights(settle(signal), lane, t.bars_day(spark, sf).select("ts"))


def _books(spark, sf):
    """Two signal variants as two books of one job, and their bars."""
    bars = settle(t.bars_week(spark, sf))
    every = None
    for name, window in (("w10", 10), ("w30", 30)):
        signal, lane = run_trend_signal(bars.withColumn("variant", F.lit(name)), window, keys=("variant", "symbol"), timeframe="1w")
        one = rb.signal_weights(signal, lane)
        every = one if every is None else every.unionByName(one)
    return bars, settle(every)


define("nav_weights", """SELECT 'w10' AS variant, symbol, ts, 1.0::DOUBLE/(SELECT count(DISTINCT symbol) FROM w10_sig) AS weight FROM w10_sig WHERE signal_open = 1
UNION ALL SELECT 'w30', symbol, ts, 1.0::DOUBLE/(SELECT count(DISTINCT symbol) FROM w30_sig) FROM w30_sig WHERE signal_open = 1""")
define("nav_calendar", "SELECT ts, lag(ts) OVER (ORDER BY ts) AS pts, lead(ts) OVER (ORDER BY ts) AS nts FROM (SELECT DISTINCT ts FROM bars_week)")
define("nav_steps", """SELECT symbol, ts, CASE WHEN own = pts THEN close/before - 1 END AS ret FROM (
 SELECT symbol, ts, close, lag(close) OVER w AS before, lag(ts) OVER w AS own FROM bars_week WINDOW w AS (PARTITION BY symbol ORDER BY ts)) JOIN nav_calendar USING (ts)""")
define("nav_held", """SELECT variant, nts AS ts, symbol, weight AS before, coalesce(ret, 0) AS ret FROM nav_weights JOIN nav_calendar USING (ts)
LEFT JOIN nav_steps s ON s.symbol = nav_weights.symbol AND s.ts = nts WHERE nts IS NOT NULL""".replace("symbol, weight AS", "nav_weights.symbol, weight AS"))
define("nav_gross", "SELECT variant, ts, sum(before*ret) AS gross FROM nav_held GROUP BY ALL")
define("nav_changes", """SELECT variant, ts, symbol, gross, coalesce(weight, 0) - coalesce(before*(1 + ret)/(1 + gross), 0) AS change FROM (
 SELECT * FROM nav_held FULL JOIN nav_weights USING (variant, ts, symbol)) LEFT JOIN (SELECT variant, ts, gross FROM nav_gross) USING (variant, ts)""")
define("nav_books", """SELECT variant, ts, gross, turnover, 1000000.0::DOUBLE*product((1 + gross)*(1 - turnover*0.0005::DOUBLE)) OVER (PARTITION BY variant ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nav
FROM (SELECT variant, ts, coalesce(any_value(gross), 0) AS gross, sum(abs(change)) AS turnover FROM nav_changes GROUP BY ALL)""")

for _suffix, _layout in (("", {}), ("_blocked", {"block_rows": 60, "slice_rows": 8})):
    query(f"rebalance_nav{_suffix}", "variant ts", nums="gross turnover nav", digits=5, sql="SELECT * FROM nav_books")(
        lambda spark, sf, layout=_layout: rb.held_nav(*_books(spark, sf), timeframe="1w", **layout))


@query("rebalance_trades", "variant ts symbol", nums="change notional", digits=4,
       sql="SELECT c.variant, c.ts, symbol, change, change*nav AS notional FROM nav_changes c JOIN nav_books USING (variant, ts) WHERE abs(change) > 1e-9::DOUBLE")
def rebalance_trades(spark, sf):
    bars, weights = _books(spark, sf)
    return rb.held_trades(bars, weights, rb.held_nav(bars, weights, timeframe="1w"), timeframe="1w")


@query("rebalance_summary", "variant", "num_trades", "total_return ann_return ann_vol sharpe max_drawdown calmar",
       sql="""SELECT variant, num_trades, total_return, ann_return, ann_vol, CASE WHEN ann_vol > 0 THEN mu*252/ann_vol ELSE 0 END AS sharpe, max_drawdown, CASE WHEN max_drawdown < 0 THEN ann_return/abs(max_drawdown) END AS calmar FROM (
 SELECT variant, arg_max(nav, ts)/arg_min(nav, ts) - 1 AS total_return, pow(arg_max(nav, ts)/arg_min(nav, ts), 252.0::DOUBLE/count(*)) - 1 AS ann_return, stddev_samp(r)*sqrt(252) AS ann_vol, avg(r) AS mu, min(nav/k - 1) AS max_drawdown
 FROM (SELECT *, nav/lag(nav) OVER w - 1 AS r, max(nav) OVER w AS k FROM nav_books WINDOW w AS (PARTITION BY variant ORDER BY ts)) GROUP BY variant)
JOIN (SELECT variant, count(*) AS num_trades FROM nav_changes WHERE abs(change) > 1e-9::DOUBLE GROUP BY variant) USING (variant)""")
def rebalance_summary(spark, sf):
    bars, weights = _books(spark, sf)
    nav = settle(rb.held_nav(bars, weights, timeframe="1w"))
    return metrics.nav_summary(nav, ["variant"], rb.held_trades(bars, weights, nav, timeframe="1w"), timeframe="1w")


@query("benchmark_nav", "symbol ts", nums="nav", digits=4,
       sql="""SELECT symbol, ts, rate/first(rate) OVER (PARTITION BY symbol ORDER BY ts)*1000000 AS nav FROM (SELECT b.symbol, b.ts, d.close AS rate FROM bars_week b ASOF JOIN (SELECT * FROM bars_day) d ON d.symbol = b.symbol AND b.ts >= d.ts)""")
def benchmark_nav(spark, sf):
    """A daily benchmark on the weekly calendar, scaled to the initial capital."""
    weeks = t.bars_week(spark, sf).select("symbol", "ts")
    found = asof.as_of(weeks, t.bars_day(spark, sf), ["symbol"], "ts", "close", "nav", timeframe="1d").where(F.col("nav").isNotNull())
    return metrics.normalise_to(settle(found.select("symbol", "ts", "nav")), ["symbol"], "nav", 1_000_000.0)


@query("nav_summary", "symbol", nums="total_return ann_return ann_vol sharpe max_drawdown calmar",
       sql="""SELECT symbol, total_return, ann_return, ann_vol, CASE WHEN ann_vol > 0 THEN mu*252/ann_vol ELSE 0 END AS sharpe, max_drawdown, CASE WHEN max_drawdown < 0 THEN ann_return/abs(max_drawdown) END AS calmar FROM (
 SELECT symbol, arg_max(close, ts)/arg_min(close, ts) - 1 AS total_return, pow(arg_max(close, ts)/arg_min(close, ts), 252.0::DOUBLE/count(*)) - 1 AS ann_return, stddev_samp(r)*sqrt(252) AS ann_vol, avg(r) AS mu, min(close/k - 1) AS max_drawdown
 FROM (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars_week) GROUP BY symbol)""")
def nav_summary(spark, sf):
    return metrics.nav_summary(t.bars_week(spark, sf).withColumnRenamed("close", "nav"), ["symbol"], timeframe="1w")
