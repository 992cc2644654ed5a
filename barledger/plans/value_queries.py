"""Queries on values through time: as-of lookups, target segments, NAV panel, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.functions import calendars
from barledger.operators import asof, book as bk, performance, periods, projection, reconcile, returns as rt
from barledger.plans import tables as t
from barledger.plans.book_queries import panel_and_values
from barledger.plans.metric_queries import nav_periods_sql
from barledger.plans.oracle_base import define
from barledger.plans.registry import query
from barledger.session import settle

END = "2001-06-30"


def end_date():
    return F.lit(END).cast("date")


def start_date():
    return F.lit(t.STATEMENT_DATE).cast("date")


def prices(spark, sf):
    return t.bars_week(spark, sf).select(F.col("symbol").alias("ticker"), "ts", "close")


def book_tables(spark, sf):
    """Portfolio, holding, universe, targets, prices and rates, each settled once."""
    held = settle(t.holding(spark, sf))
    return (
        settle(t.portfolio(spark, sf, held)), held, t.universe(spark, sf), settle(t.target_weight(spark, sf)),
        settle(prices(spark, sf)), settle(t.fx(spark, sf)),
    )


define("month_targets", """SELECT name, eff_date, ticker, v/sum(v) OVER (PARTITION BY name, eff_date) AS weight FROM (
 SELECT r_name AS name, date_trunc('month', o_orderdate)::DATE AS eff_date, o_orderpriority AS ticker, sum(o_totalprice) AS v
 FROM region_orders WHERE o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate <= TIMESTAMP '2001-06-30' GROUP BY ALL)""")
define("quotes", "SELECT symbol AS ticker, ts, close FROM bars_week")


@query("asof_prices", "ticker day quoted", nums="close",
       sql="""SELECT d.ticker, d.day, q.ts AS quoted, q.close FROM (SELECT DISTINCT o_orderpriority AS ticker, o_orderdate::DATE AS day FROM orders) d
 ASOF LEFT JOIN quotes q ON d.ticker = q.ticker AND d.day::TIMESTAMP >= q.ts""")
def asof_prices(spark, sf):
    orders = t.table(spark, sf, "orders")
    probes = orders.select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    return asof.as_of(probes, prices(spark, sf), ["ticker"], "day", "close", "close", timeframe="1d").withColumnRenamed("close_ts", "quoted")


@query("asof_prices_blocked", "ticker day quoted", nums="close",
       sql="""SELECT d.ticker, d.day, q.ts AS quoted, q.close FROM (SELECT DISTINCT o_orderpriority AS ticker, o_orderdate::DATE AS day FROM orders) d
 ASOF LEFT JOIN quotes q ON d.ticker = q.ticker AND d.day::TIMESTAMP >= q.ts""")
def asof_prices_blocked(spark, sf):
    orders = t.table(spark, sf, "orders")
    probes = orders.select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    found = asof.as_of(probes, prices(spark, sf), ["ticker"], "day", "close", "close", timeframe="1d", block_rows=300, slice_rows=40)
    return found.withColumnRenamed("close_ts", "quoted")


@query("asof_rates_blocked", "o_orderkey", nums="rate",
       sql="SELECT o_orderkey, f.rate FROM orders o ASOF LEFT JOIN fx f ON o.o_orderdate >= f.ts")
def asof_rates_blocked(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return asof.as_of_single(orders, t.fx(spark, sf), "o_orderdate", "rate", "rate", timeframe="1d", block_rows=300, slice_rows=40)


@query("asof_rates", "o_orderkey", nums="rate",
       sql="SELECT o_orderkey, f.rate FROM orders o ASOF LEFT JOIN fx f ON o.o_orderdate >= f.ts")
def asof_rates(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return asof.as_of_single(orders, t.fx(spark, sf), "o_orderdate", "rate", "rate", timeframe="1d")


@query("target_intervals", "name eff_date eff_to", nums="weight_sum",
       sql="""SELECT name, eff_date, lead(eff_date) OVER (PARTITION BY name ORDER BY eff_date) AS eff_to, weight_sum FROM (SELECT name, eff_date, sum(weight) AS weight_sum FROM month_targets GROUP BY ALL)""")
def target_intervals(spark, sf):
    return asof.target_intervals(month_targets(spark, sf))


def month_targets(spark, sf):
    """One target snapshot per month between the statement and the valuation, from all orders of that month."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    rows = t.orders_by_region(spark, sf).where(
        (F.col("o_orderdate") >= F.lit(t.TARGET_FROM).cast("timestamp_ntz")) & (F.col("o_orderdate") <= F.lit(END).cast("timestamp_ntz"))
    ).groupBy(F.col("r_name").alias("name"), month.alias("eff_date"), F.col("o_orderpriority").alias("ticker")).agg(F.sum("o_totalprice").alias("v"))
    total = rows.groupBy("name", "eff_date").agg(F.sum("v").alias("_t"))
    return rows.join(total, ["name", "eff_date"]).select("name", "eff_date", "ticker", (F.col("v") / F.col("_t")).alias("weight"))


@query("effective_targets", "name eff_date ticker", nums="weight",
       sql="SELECT * FROM month_targets WHERE eff_date = (SELECT max(eff_date) FROM month_targets WHERE eff_date <= DATE '2001-01-15')")
def effective_targets(spark, sf):
    return asof.effective_targets(t.portfolio(spark, sf), settle(month_targets(spark, sf)), F.lit("2001-01-15"))


@query("calendar_fill", "symbol ts", nums="close",
       sql="""WITH c AS (SELECT symbol, unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT symbol FROM bars_day)),
 j AS (SELECT symbol, ts, close FROM c LEFT JOIN bars_day USING (symbol, ts))
SELECT symbol, ts, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM j""")
def calendar_fill(spark, sf):
    bars = t.bars_day(spark, sf)
    spans = bars.select("symbol").distinct().withColumns({"a": F.lit("1998-01-01").cast("date"), "b": F.lit("1998-12-31").cast("date")})
    cal = calendars.calendar_days(spans, "a", "b").select("symbol", F.col("day").cast("timestamp_ntz").alias("ts"))
    return asof.fill_to_calendar(bars, cal, ["symbol"], "close", back_fill=True, timeframe="1d")


@query("date_arithmetic", "day business_day month_before",
       sql="""SELECT DISTINCT o_orderdate::DATE AS day, (o_orderdate - INTERVAL 1 DAY * greatest(isodow(o_orderdate) - 5, 0))::DATE AS business_day,
 (o_orderdate - INTERVAL 1 MONTH)::DATE AS month_before FROM orders""")
def date_arithmetic(spark, sf):
    days = t.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", calendars.last_business_day(F.col("day")).alias("business_day"), calendars.month_before(F.col("day")).alias("month_before"))


define("segs", f"""SELECT name, seg_start, coalesce(lead(seg_start) OVER w, DATE '{END}') AS seg_end, lead(seg_start) OVER w IS NULL AS is_last,
  CASE WHEN seg_start = DATE '2000-06-30' THEN 'statement' ELSE 'target' END AS basis
FROM (SELECT name, statement_date AS seg_start FROM portfolio UNION ALL SELECT DISTINCT name, eff_date FROM month_targets) WINDOW w AS (PARTITION BY name ORDER BY seg_start)""")
define("segw", """SELECT s.name, seg_start, seg_end, is_last, ticker, weight FROM segs s JOIN holding h ON s.name = h.name WHERE basis = 'statement'
UNION ALL SELECT s.name, seg_start, seg_end, is_last, ticker, weight FROM segs s JOIN month_targets m ON s.name = m.name AND s.seg_start = m.eff_date""")
define("seg_prices", """SELECT s.*, a.close AS p0, a.ts::DATE AS d0, b.close AS p1, b.ts::DATE AS d1
FROM segw s ASOF LEFT JOIN quotes a ON s.ticker = a.ticker AND s.seg_start::TIMESTAMP >= a.ts ASOF LEFT JOIN quotes b ON s.ticker = b.ticker AND s.seg_end::TIMESTAMP >= b.ts""")
define("piecewise", f"""SELECT p.*, total_value*chain*(1 - fee_annual*date_diff('day', statement_date, DATE '{END}')/365) AS today_native FROM portfolio p JOIN (
 SELECT name, product(f) AS chain FROM (SELECT name, seg_start, sum(weight*p1/p0*CASE WHEN ticker = '5-LOW' AND d1 < seg_end
   THEN pow(pow(p1/p0, 365.0::DOUBLE/greatest(date_diff('day', d0, d1), 1)), date_diff('day', d1, seg_end)/365.0::DOUBLE) ELSE 1 END) AS f FROM seg_prices GROUP BY ALL) GROUP BY name) USING (name)""")


@query("target_segments", "name seg_start seg_end basis", sql="SELECT * FROM segs")
def target_segments(spark, sf):
    return projection.segments(t.portfolio(spark, sf), settle(month_targets(spark, sf)), end_date())


def monthly_book(spark, sf):
    p, h, u, _, q, fx = book_tables(spark, sf)
    return p, h, u, settle(month_targets(spark, sf)), q, fx


@query("piecewise_values", "name", nums="today_native", digits=1, sql="SELECT * FROM piecewise")
def piecewise_values(spark, sf):
    p, h, u, targets, q, _ = monthly_book(spark, sf)
    return projection.piecewise_values(p, h, u, targets, q, end_date())


define("recon", f"""SELECT 'current' AS book_id, name, currency, total_value AS stmt_native, total_value*coalesce(CASE WHEN currency = 'USD' THEN statement_fx END, 1) AS stmt_base, today_native,
  today_native*CASE WHEN currency = 'USD' THEN (SELECT arg_max(rate, ts) FROM fx) ELSE 1 END AS today_base FROM piecewise""")


@query("portfolio_reconciliation", "name currency", nums="stmt_native stmt_base today_native today_base delta_base", digits=3,
       sql="SELECT *, today_base - stmt_base AS delta_base FROM recon")
def portfolio_reconciliation(spark, sf):
    return reconcile.portfolio_reconciliation(*monthly_book(spark, sf), end_date())


@query("portfolio_reconciliation_returns", "name", nums="return_native return_base",
       sql="SELECT name, today_native/stmt_native - 1 AS return_native, today_base/stmt_base - 1 AS return_base FROM recon")
def portfolio_reconciliation_returns(spark, sf):
    return reconcile.portfolio_reconciliation(*monthly_book(spark, sf), end_date())


@query("reconciliation_totals", "book_id name", "is_total", "return_base",
       sql="""SELECT book_id, name, grouping(name) AS is_total, sum(today_base)/sum(stmt_base) - 1 AS return_base FROM recon GROUP BY GROUPING SETS ((book_id, name), (book_id))""")
def reconciliation_totals(spark, sf):
    return reconcile.with_totals(reconcile.portfolio_reconciliation(*monthly_book(spark, sf), end_date()))


@query("target_coverage", "name ticker", nums="weight",
       sql="""SELECT name, ticker, weight FROM target_weight t WHERE NOT EXISTS (SELECT 1 FROM holding h WHERE h.name = t.name AND h.ticker NOT IN (
 SELECT ticker FROM target_weight x WHERE x.name = t.name AND NOT (name = 'ASIA' AND ticker = '2-HIGH'))) AND NOT (name = 'ASIA' AND ticker = '2-HIGH')""")
def target_coverage(spark, sf):
    targets = t.target_weight(spark, sf).where("NOT (name = 'ASIA' AND ticker = '2-HIGH')")
    return reconcile.covered_targets(t.portfolio(spark, sf), t.holding(spark, sf), settle(targets), end_date())


@query("holdings_reconciliation", "name ticker label weight_basis", "accrued_days", "weight stmt_price today_price ret",
       sql=f"""SELECT h.name, h.ticker, asset_class || ' · ' || region AS label, 'target' AS weight_basis, t.weight, a.close AS stmt_price,
 CASE WHEN h.ticker = '5-LOW' THEN date_diff('day', b.ts::DATE, DATE '{END}') ELSE 0 END AS accrued_days, b.close*acc AS today_price, b.close*acc/a.close - 1 AS ret
FROM holding h JOIN target_weight t USING (name, ticker) JOIN universe USING (ticker)
 JOIN (SELECT ticker, arg_max(close, ts) AS close, max(ts) AS ts FROM quotes WHERE ts <= TIMESTAMP '2000-06-30' GROUP BY 1) a USING (ticker)
 JOIN (SELECT ticker, arg_max(close, ts) AS close, max(ts) AS ts FROM quotes WHERE ts <= TIMESTAMP '{END}' GROUP BY 1) b USING (ticker),
 LATERAL (SELECT CASE WHEN h.ticker = '5-LOW' THEN pow(pow(b.close/a.close, 365.0::DOUBLE/date_diff('day', a.ts::DATE, b.ts::DATE)), date_diff('day', b.ts::DATE, DATE '{END}')/365.0::DOUBLE) ELSE 1 END AS acc)""")
def holdings_reconciliation(spark, sf):
    return reconcile.holdings_reconciliation(*book_tables(spark, sf), end_date())


@query("holdings_reconciliation_values", "name ticker", nums="stmt_value today_value delta stmt_value_base today_value_base delta_base", digits=2,
       sql=f"""SELECT *, today_value - stmt_value AS delta, today_value_base - stmt_value_base AS delta_base FROM (
 SELECT h.name, h.ticker, t.weight*total_value AS stmt_value, t.weight*total_value*b.close*acc/a.close AS today_value, t.weight*total_value*statement_fx AS stmt_value_base,
  CASE WHEN currency = 'USD' THEN t.weight*total_value*b.close*acc/a.close*(SELECT arg_max(rate, ts) FROM fx) END AS today_value_base
FROM holding h JOIN portfolio USING (name) JOIN target_weight t USING (name, ticker)
 JOIN (SELECT ticker, arg_max(close, ts) AS close, max(ts) AS ts FROM quotes WHERE ts <= TIMESTAMP '2000-06-30' GROUP BY 1) a USING (ticker)
 JOIN (SELECT ticker, arg_max(close, ts) AS close, max(ts) AS ts FROM quotes WHERE ts <= TIMESTAMP '{END}' GROUP BY 1) b USING (ticker),
 LATERAL (SELECT CASE WHEN h.ticker = '5-LOW' THEN pow(pow(b.close/a.close, 365.0::DOUBLE/date_diff('day', a.ts::DATE, b.ts::DATE)), date_diff('day', b.ts::DATE, DATE '{END}')/365.0::DOUBLE) ELSE 1 END AS acc))""")
def holdings_reconciliation_values(spark, sf):
    return reconcile.holdings_reconciliation(*book_tables(spark, sf), end_date())


define("day_rates", f"""SELECT day, coalesce(last_value(rate IGNORE NULLS) OVER (ORDER BY day), first_value(rate IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate
FROM (SELECT unnest(generate_series(TIMESTAMP '2000-06-30', TIMESTAMP '{END}', INTERVAL 1 DAY))::DATE AS day) LEFT JOIN fx ON ts::DATE = day""")
define("seg_days", f"""SELECT s.name, seg_start, seg_end, is_last, s.ticker, weight, p0, day,
  coalesce(q.close, (SELECT arg_min(close, ts) FROM quotes x WHERE x.ticker = s.ticker AND x.ts >= TIMESTAMP '2000-06-30' AND x.ts <= s.seg_end::TIMESTAMP))
  * CASE WHEN s.ticker = '5-LOW' AND l.ld < seg_end AND day > l.ld THEN pow(pow(l.lc/p0, 365.0::DOUBLE/greatest(date_diff('day', d0, l.ld), 1)), date_diff('day', l.ld, day)/365.0::DOUBLE) ELSE 1 END AS p
FROM (SELECT *, unnest(generate_series(seg_start::TIMESTAMP, seg_end::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM seg_prices) s
 ASOF LEFT JOIN (SELECT * FROM quotes WHERE ts >= TIMESTAMP '2000-06-30') q ON q.ticker = s.ticker AND s.day::TIMESTAMP >= q.ts
 JOIN (SELECT ticker, arg_max(close, ts) AS lc, max(ts)::DATE AS ld FROM quotes WHERE ts <= TIMESTAMP '{END}' GROUP BY 1) l ON l.ticker = s.ticker""")
define("seg_factors", "SELECT name, seg_start, seg_end, is_last, day, sum(weight*p/p0) AS f FROM seg_days GROUP BY ALL")
define("nav_days", """SELECT f.name, day, total_value*opening*f*(1 - fee_annual*date_diff('day', statement_date, day)/365)
  * CASE WHEN currency = 'USD' THEN CASE WHEN day = statement_date THEN statement_fx ELSE rate END ELSE 1 END AS nav
FROM seg_factors f JOIN (SELECT name, seg_start, coalesce(product(f) OVER (PARTITION BY name ORDER BY seg_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS opening
  FROM seg_factors WHERE day = seg_end) o USING (name, seg_start) JOIN portfolio USING (name) JOIN day_rates USING (day) WHERE day < seg_end OR is_last""")


def daily_nav(spark, sf):
    p, *rest = monthly_book(spark, sf)
    return settle(projection.nav_panel(p, *rest, start_date(), end_date())), p


@query("nav_panel", "name day", nums="nav", digits=0, sql="SELECT * FROM nav_days")
def nav_panel(spark, sf):
    return daily_nav(spark, sf)[0]


BOOK_NAV_DAYS = "SELECT 'current' AS book_id, day::TIMESTAMP AS ts, sum(nav) AS nav FROM nav_days GROUP BY day HAVING count(nav) = (SELECT count(*) FROM portfolio)"


@query("book_nav_daily", "book_id ts", nums="nav", digits=0, sql=BOOK_NAV_DAYS)
def book_nav_daily(spark, sf):
    return projection.book_nav_from_panel(*daily_nav(spark, sf))


@query("book_since_statement", "book_id period", "days", "cum_return ann_return ann_vol sharpe max_dd",
       sql=nav_periods_sql(BOOK_NAV_DAYS, "book_id"))
def book_since_statement(spark, sf):
    """Period table of the buy-and-hold NAV since the statement."""
    nav = settle(projection.book_nav_from_panel(*daily_nav(spark, sf)).withColumn("statement_date", start_date()))
    return periods.nav_periods(nav, ["book_id"], timeframe="1d")


@query("book_period_dollars", "book_id period", nums="cum_dollar", digits=2,
       sql="""SELECT 'current' AS book_id, period, cum*(SELECT sum(value_base) FROM pvalues) AS cum_dollar FROM (
 SELECT '1M' AS period, product(1 + ret) - 1 AS cum FROM (SELECT ret FROM book_ret ORDER BY ts DESC LIMIT 21)
 UNION ALL SELECT '1Y', product(1 + ret) - 1 FROM (SELECT ret FROM book_ret ORDER BY ts DESC LIMIT 252)
 UNION ALL SELECT 'All', product(1 + ret) - 1 FROM book_ret)""")
def book_period_dollars(spark, sf):
    returns, worth = panel_and_values(spark, sf)
    table = performance.book_periods(rt.book_returns(returns, worth), timeframe="1w")
    return reconcile.cum_dollars(table.where(F.col("period").isin("1M", "1Y", "All")), worth.select("book_id", "aum").distinct())


@query("book_windowed", "book_id period", "days", "cum_return ann_return ann_vol sharpe max_dd",
       sql=f"""SELECT * FROM ({nav_periods_sql(BOOK_NAV_DAYS, 'book_id')}) WHERE period LIKE 'Since stmt%' UNION ALL
SELECT * FROM ({nav_periods_sql('SELECT book_id, ts, product(1 + ret) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nav FROM book_ret', 'book_id')}) WHERE period NOT LIKE 'Since stmt%'""")
def book_windowed(spark, sf):
    held, book = daily_nav(spark, sf)
    since = projection.book_nav_from_panel(held, book).withColumn("statement_date", start_date())
    returns, worth = panel_and_values(spark, sf)
    long_nav = settle(performance.book_nav(rt.book_returns(returns, worth), "1w"))
    return performance.book_windowed(settle(since), long_nav, worth.select("book_id", "aum").distinct(), timeframe="1d")


@query("tickers_in_use", "ticker", sql="SELECT ticker FROM holding UNION SELECT ticker FROM month_targets")
def tickers_in_use(spark, sf):
    return bk.tickers_in_use(t.holding(spark, sf), month_targets(spark, sf))
