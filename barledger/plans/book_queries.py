"""Queries over a book of portfolios: exposure, returns, correlation, risk, benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.functions.ordered import Lane
from barledger.operators import book, metrics, performance, returns as rt, risk
from barledger.plans import tables as t
from barledger.plans.metric_queries import metrics_sql, periods_sql
from barledger.plans.oracle_base import define
from barledger.plans.registry import query
from barledger.session import settle


def ticker_returns(spark, sf):
    """Weekly returns per ticker."""
    bars = t.bars_week(spark, sf)
    return metrics.simple_returns(bars, Lane(("symbol",))).select(F.col("symbol").alias("ticker"), "ts", "ret")


def panel_and_values(spark, sf):
    """Returns panel and base-currency values of the current book; shared inputs are settled once."""
    held = settle(t.holding(spark, sf))
    book_table, rates = settle(t.portfolio(spark, sf, held)), settle(t.fx(spark, sf))
    returns = settle(rt.returns_panel(book_table, held, ticker_returns(spark, sf), rates, "1w"))
    return returns, settle(book.portfolio_values(book_table, book.book_fx(book_table, rates)))


def panel(spark, sf):
    held = settle(t.holding(spark, sf))
    book_table = t.portfolio(spark, sf, held)
    return settle(rt.returns_panel(book_table, held, ticker_returns(spark, sf), t.fx(spark, sf), "1w"))


CORR_SQL = """SELECT 'current' AS book_id, a.name AS name_a, b.name AS name_b, count(*) AS n_obs,
  CASE WHEN count(*) >= 20 THEN corr(a.ret, b.ret) END AS rho FROM panel a JOIN panel b USING (ts) WHERE {} GROUP BY ALL"""
define("supp_ret", "SELECT symbol, ts, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars_supplier")
define("week_complete", "SELECT ts FROM week_ret WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars_week)")
define("panel_raw", """SELECT name, ts, sum(weight*ret) - any_value(fee_annual)/252 AS ret, any_value(currency) AS currency
FROM holding JOIN portfolio USING (name) JOIN week_ret ON symbol = ticker JOIN week_complete USING (ts) GROUP BY name, ts""")
define("panel", """SELECT name, ts, CASE WHEN currency = 'USD' THEN (1 + ret)*(1 + coalesce(f/lag(f) OVER w - 1, 0)) - 1 ELSE ret END AS ret FROM (
 SELECT *, coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts), first_value(rate IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f
 FROM panel_raw LEFT JOIN fx USING (ts)) WINDOW w AS (PARTITION BY name ORDER BY ts)""")
define("pvalues", "SELECT *, total_value*CASE WHEN currency = 'USD' THEN 1.3::DOUBLE ELSE 1 END AS value_base FROM portfolio")
define("book_ret", "SELECT 'current' AS book_id, ts, sum(ret*value_base)/(SELECT sum(value_base) FROM pvalues) AS ret FROM panel JOIN pvalues USING (name) GROUP BY ts HAVING count(*) = (SELECT count(*) FROM pvalues)")


@query("book_weight_check", "book_id name valid", nums="weight_sum",
       sql="SELECT 'current' AS book_id, name, sum(weight) AS weight_sum, abs(sum(weight) - 1) <= 0.0001 AS valid FROM holding GROUP BY name")
def book_weight_check(spark, sf):
    return book.weight_report(book.check_weights(t.holding(spark, sf)))


@query("book_unknown_assets", "ticker", "n",
       sql="SELECT ticker, count(*) AS n FROM holding WHERE ticker NOT IN (SELECT ticker FROM universe WHERE region = 'US') GROUP BY 1")
def book_unknown_assets(spark, sf):
    partial = t.universe(spark, sf).where(F.col("region") == "US")
    return book.unknown_assets(t.holding(spark, sf), partial).groupBy("ticker").agg(F.count("*").alias("n"))


@query("book_cash_like", "ticker cash_like", sql="SELECT ticker, asset_class = 'Cash' OR coalesce(sector, '') ILIKE '%money market%' AS cash_like FROM universe")
def book_cash_like(spark, sf):
    return t.universe(spark, sf).select("ticker", book.is_cash_like().alias("cash_like"))


@query("book_weights_normalised", "name ticker", nums="weight",
       sql="""SELECT name, ticker, CASE WHEN ticker = '5-LOW' THEN w + 1 - sum(w) OVER (PARTITION BY name) ELSE w END AS weight FROM (
 SELECT name, ticker, round(value/sum(value) OVER (PARTITION BY name), 6) AS w FROM holding)""")
def book_weights_normalised(spark, sf):
    rows = t.holding(spark, sf).withColumn("ord", F.substring("ticker", 1, 1).cast("int"))
    return book.normalise_weights(rows)


@query("exposure", "book_id dimension bucket", nums="value weight", digits=4,
       sql="""SELECT 'current' AS book_id, dimension, bucket, value, value/sum(value) OVER (PARTITION BY dimension) AS weight FROM (
 SELECT dimension, bucket, sum(weight*total_value) AS value FROM holding JOIN portfolio USING (name) JOIN universe USING (ticker),
 LATERAL (VALUES ('asset_class', asset_class), ('region', region), ('sector', coalesce(sector, 'Unspecified'))) d(dimension, bucket) GROUP BY 1, 2)""")
def exposure(spark, sf):
    return book.exposure(t.portfolio(spark, sf), t.holding(spark, sf), t.universe(spark, sf))


@query("exposure_ranked", "book_id dimension bucket", "rank", "value", digits=4,
       sql="""SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, bucket) AS rank FROM (
 SELECT 'current' AS book_id, dimension, bucket, sum(weight*total_value) AS value FROM holding JOIN portfolio USING (name) JOIN universe USING (ticker),
 LATERAL (VALUES ('asset_class', asset_class), ('region', region), ('sector', coalesce(sector, 'Unspecified'))) d(dimension, bucket) GROUP BY ALL)""")
def exposure_ranked(spark, sf):
    rows = book.exposure(t.portfolio(spark, sf), t.holding(spark, sf), t.universe(spark, sf))
    return book.ranked(rows, ["book_id", "dimension"], "value", ["bucket"])


@query("exposure_by_role", "book_id dimension bucket", nums="value weight", digits=4,
       sql="""SELECT 'current' AS book_id, dimension, bucket, value, value/sum(value) OVER (PARTITION BY dimension) AS weight FROM (
 SELECT dimension, bucket, sum(weight*total_value) AS value FROM holding JOIN portfolio USING (name) JOIN universe USING (ticker),
 LATERAL (VALUES ('asset_class', asset_class), ('region', region), ('sector', coalesce(sector, 'Unspecified'))) d(dimension, bucket) WHERE currency <> 'USD' GROUP BY 1, 2)""")
def exposure_by_role(spark, sf):
    """Portfolios in dollars are benchmarks only here: without the holding role they do not count."""
    roles = F.when(F.col("currency") == "USD", F.array(F.lit("managed_benchmark"))).otherwise(F.col("roles"))
    return book.exposure(t.portfolio(spark, sf).withColumn("roles", roles), t.holding(spark, sf), t.universe(spark, sf))


@query("portfolio_returns", "book_id name ts", nums="ret", digits=8, sql="SELECT 'current' AS book_id, * FROM panel")
def portfolio_returns(spark, sf):
    return panel(spark, sf)


@query("portfolio_returns_blocked", "book_id name ts", nums="ret", digits=8, sql="SELECT 'current' AS book_id, * FROM panel")
def portfolio_returns_blocked(spark, sf):
    held = settle(t.holding(spark, sf))
    returns = settle(ticker_returns(spark, sf))
    return rt.returns_panel(t.portfolio(spark, sf, held), held, returns, t.fx(spark, sf), "1w", block_rows=40, slice_rows=8)


def book_with_cash(spark, sf):
    """The current book with a tenth of each portfolio in cash, one portfolio all in cash and one without value."""
    held = settle(t.holding(spark, sf))
    p = t.portfolio(spark, sf, held)
    cash = p.select("book_id", "name", F.concat(F.lit("CASH_"), "currency").alias("ticker"), F.lit(0.1).alias("weight"))
    invested = F.when(F.col("name") == "AFRICA", 0.0).otherwise(F.col("weight") * 0.9)
    rows = held.select("book_id", "name", "ticker", invested.alias("weight")).where("name <> 'AFRICA'").unionByName(cash)
    return p, rows


@query("portfolio_returns_with_cash", "book_id name ts", nums="ret", digits=8,
       sql="""SELECT 'current' AS book_id, name, ts, CASE WHEN name = 'AFRICA' THEN 0 ELSE sum(0.9::DOUBLE*weight*ret) END - any_value(fee_annual)/252 AS ret
FROM holding JOIN portfolio USING (name) JOIN week_ret ON symbol = ticker JOIN week_complete USING (ts) WHERE name <> 'AFRICA' GROUP BY name, ts
UNION ALL SELECT 'current', 'AFRICA', ts, 0 - fee_annual/252 FROM portfolio, (SELECT DISTINCT ts FROM week_ret WHERE ret IS NOT NULL) WHERE name = 'AFRICA'""")
def portfolio_returns_with_cash(spark, sf):
    p, rows = book_with_cash(spark, sf)
    return rt.portfolio_returns(p, rows, settle(ticker_returns(spark, sf)), timeframe="1w")


@query("portfolio_rejects", "book_id name reason",
       sql="""SELECT DISTINCT 'current' AS book_id, name, 'no returns for ' || string_agg(DISTINCT ticker, ', ' ORDER BY ticker) AS reason
FROM holding WHERE ticker IN (SELECT ticker FROM universe WHERE region = 'US') GROUP BY name""")
def portfolio_rejects(spark, sf):
    """Returns of tickers outside one region only: every portfolio that holds the others is named."""
    known = t.universe(spark, sf).where("region <> 'US'").select("ticker")
    return rt.portfolio_rejects(t.holding(spark, sf), ticker_returns(spark, sf).join(known, "ticker", "left_semi"))


@query("cash_returns", "ticker", "n", "total",
       sql="""SELECT ticker, count(*) AS n, sum(ret) AS total FROM (SELECT symbol AS ticker, ret FROM week_ret UNION ALL
 SELECT 'CASH_' || c, 0 FROM (SELECT DISTINCT ts FROM week_ret), (SELECT DISTINCT currency AS c FROM portfolio)) GROUP BY 1""")
def cash_returns(spark, sf):
    cash = t.portfolio(spark, sf).select(F.concat(F.lit("CASH_"), "currency").alias("ticker"))
    return rt.cash_returns(ticker_returns(spark, sf), cash).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("ret").alias("total"))


@query("business_day_cash", "ticker ts", nums="ret",
       sql="""SELECT 'CASH_' || currency AS ticker, ts, 0.0 AS ret FROM (SELECT currency, unnest(generate_series(min(statement_date)::TIMESTAMP, TIMESTAMP '2000-12-31', INTERVAL 1 DAY)) AS ts
 FROM portfolio GROUP BY currency) WHERE isodow(ts) < 6""")
def business_day_cash(spark, sf):
    spans = t.portfolio(spark, sf).groupBy(F.concat(F.lit("CASH_"), "currency").alias("ticker")).agg(F.min("statement_date").alias("a"))
    return rt.business_day_cash(spans.withColumn("b", F.lit("2000-12-31").cast("date")), "a", "b")


@query("dropped_portfolios", "book_id name reason",
       sql="SELECT DISTINCT 'current' AS book_id, name, 'no returns for 1-URGENT' AS reason FROM holding WHERE ticker = '1-URGENT'")
def dropped_portfolios(spark, sf):
    known = ticker_returns(spark, sf).where(F.col("ticker") != "1-URGENT")
    h = settle(t.holding(spark, sf))
    p = t.portfolio(spark, sf, h)
    return rt.dropped_portfolios(p, h, known, rt.returns_panel(p, h, known, timeframe="1w"))


@query("common_start", "book_id common_start",
       sql="SELECT 'current' AS book_id, max(f) AS common_start FROM (SELECT name, min(ts) AS f FROM panel GROUP BY name)")
def common_start(spark, sf):
    return rt.common_start(panel(spark, sf))


for _aligned in (True, False):
    query(f"book_returns_{'aligned' if _aligned else 'unaligned'}", "book_id ts", nums="ret", digits=8,
          sql="SELECT * FROM book_ret" if _aligned else
          "SELECT 'current' AS book_id, ts, sum(ret*value_base)/sum(value_base) AS ret FROM panel JOIN pvalues USING (name) GROUP BY ts")(
        lambda spark, sf, a=_aligned: rt.book_returns(*panel_and_values(spark, sf), a))

@query("correlation_matrix", "book_id name_a name_b", "n_obs", "rho", sql=CORR_SQL.format("true"))
def correlation_matrix(spark, sf):
    return risk.correlation_matrix(panel(spark, sf), timeframe="1w")


def ticker_panel(spark, sf):
    """Weekly returns of every ticker as one book; series overlap only partly."""
    return ticker_returns(spark, sf).select(F.lit("current").alias("book_id"), F.col("ticker").alias("name"), "ts", "ret")


def supplier_panel(spark, sf):
    bars = t.bars_supplier(spark, sf)
    daily = metrics.simple_returns(bars, Lane(("symbol",)))
    return daily.select(F.lit("current").alias("book_id"), F.col("symbol").alias("name"), "ts", "ret")


@query("correlation_suppliers", "name_a name_b", "n_obs", "rho",
       sql="""SELECT a.symbol AS name_a, b.symbol AS name_b, count(*) AS n_obs, CASE WHEN count(*) >= 20 THEN corr(a.ret, b.ret) END AS rho
FROM supp_ret a JOIN supp_ret b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL""")
def correlation_suppliers(spark, sf):
    """Partly overlapping daily series of all suppliers, in several tiles."""
    return risk.correlations(settle(supplier_panel(spark, sf)), timeframe="1d")



@query("redundancy_suppliers", "name_a name_b", "n_obs", "rho",
       sql="""SELECT * FROM (SELECT a.symbol AS name_a, b.symbol AS name_b, count(*) AS n_obs, CASE WHEN count(*) >= 20 THEN corr(a.ret, b.ret) END AS rho
FROM supp_ret a JOIN supp_ret b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL) WHERE rho >= 0.3::DOUBLE""")
def redundancy_suppliers(spark, sf):
    """Suppliers that move together; only the hits leave the aggregation."""
    return risk.close_pairs(settle(supplier_panel(spark, sf)), 0.3, timeframe="1d")


@query("correlation_window", "book_id name_a name_b", "n_obs", "rho",
       sql=CORR_SQL.format("a.name < b.name AND a.ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'"))
def correlation_window(spark, sf):
    return risk.correlations(panel(spark, sf), timeframe="1w", start="1997-01-01", end="1998-12-31")


@query("redundancy_pairs", "book_id name_a name_b candidate", nums="rho",
       sql=f"""SELECT book_id, name_a, name_b, rho, CASE WHEN name_b = 'ASIA' THEN name_a ELSE name_b END AS candidate
FROM ({CORR_SQL.format('a.name < b.name')}) WHERE rho >= 0.85""")
def redundancy_pairs(spark, sf):
    return risk.redundancy_pairs(risk.correlations(panel(spark, sf), timeframe="1w"), t.portfolio(spark, sf))


COV_SQL = """SELECT a.symbol AS name_a, b.symbol AS name_b, covar_samp(a.ret, b.ret)*252 AS cov FROM week_ret a JOIN week_ret b USING (ts) JOIN week_complete USING (ts) GROUP BY ALL"""


@query("covariance", "name_a name_b", nums="cov", digits=8, sql=f"SELECT * FROM ({COV_SQL}) WHERE name_a <= name_b")
def covariance(spark, sf):
    return risk.covariance(settle(ticker_panel(spark, sf)), timeframe="1w")


define("cov", COV_SQL)
define("hw", "SELECT name, ticker, weight*value_base AS value, weight*value_base/(SELECT sum(value_base) FROM pvalues) AS weight FROM holding JOIN pvalues USING (name)")
define("tw", "SELECT ticker, sum(weight) AS weight, sum(value) AS value, string_agg(DISTINCT name, ', ' ORDER BY name) AS portfolios, count(DISTINCT name) AS n_portfolios FROM hw GROUP BY ticker")
define("sig", "SELECT sqrt(sum(a.weight*b.weight*cov)) AS sigma FROM cov JOIN tw a ON a.ticker = name_a JOIN tw b ON b.ticker = name_b")
define("rt", """SELECT a.ticker, any_value(a.weight) AS weight, any_value(a.value) AS value, any_value(a.portfolios) AS portfolios, any_value(a.n_portfolios) AS n_portfolios,
 any_value(a.weight)*sum(b.weight*cov)/(SELECT sigma FROM sig) AS contribution FROM tw a JOIN cov ON name_a = a.ticker JOIN tw b ON b.ticker = name_b GROUP BY a.ticker""")


def _left_out(key: str) -> str:
    """Volatility after removing each ``key`` group, from the covariance matrix."""
    return f"""SELECT x AS k, sqrt(greatest(sum(a.w*b.w*cov), 0)) AS s FROM (
   SELECT x, ticker, sum(weight)/sum(sum(weight)) OVER (PARTITION BY x) AS w FROM hw, (SELECT DISTINCT {key} AS x FROM hw) WHERE {key} <> x GROUP BY x, ticker) a
  JOIN cov ON name_a = a.ticker JOIN (SELECT x AS y, ticker, sum(weight)/sum(sum(weight)) OVER (PARTITION BY x) AS w FROM hw, (SELECT DISTINCT {key} AS x FROM hw) WHERE {key} <> x GROUP BY x, ticker) b
  ON b.y = a.x AND b.ticker = name_b GROUP BY x"""


def risk_model(spark, sf):
    held = settle(t.holding(spark, sf))
    p = t.portfolio(spark, sf, held)
    rows = settle(risk.book_holdings(p, held, book.book_fx(p)))
    return risk.RiskModel(rows, settle(ticker_returns(spark, sf)))


RISK_NUMS = "weight contribution pct_total delta_vol"


@query("risk_holders", "book_id ticker name", nums="weight value", digits=5, sql="SELECT 'current' AS book_id, ticker, name, weight, value FROM hw")
def risk_holders(spark, sf):
    return risk_model(spark, sf).holders()


@query("risk_by_ticker", "ticker portfolios", "n_portfolios", RISK_NUMS, sql=f"""SELECT rt.*, contribution/sigma AS pct_total, sigma - s AS delta_vol
FROM rt JOIN ({_left_out('ticker')}) ON k = ticker, sig""")
def risk_by_ticker(spark, sf):
    return risk_model(spark, sf).by_ticker()


@query("risk_ranked", "book_id ticker", "rank", "contribution", sql="SELECT 'current' AS book_id, ticker, contribution, row_number() OVER (ORDER BY contribution DESC, ticker) AS rank FROM rt")
def risk_ranked(spark, sf):
    return book.ranked(risk_model(spark, sf).by_ticker(), ["book_id"], "contribution", ["ticker"])


@query("risk_by_holding", "name ticker holding", nums=RISK_NUMS, sql=f"""SELECT hw.name, hw.ticker, hw.name || ' · ' || hw.ticker AS holding, hw.weight, contribution*hw.weight/rt.weight AS contribution,
 contribution*hw.weight/rt.weight/sigma AS pct_total, sigma - s AS delta_vol FROM hw JOIN rt USING (ticker) JOIN ({_left_out("name || '|' || ticker")}) ON k = hw.name || '|' || hw.ticker, sig""")
def risk_by_holding(spark, sf):
    return risk_model(spark, sf).by_holding()


@query("risk_by_portfolio", "name", nums=RISK_NUMS, sql=f"""SELECT name, weight, contribution, contribution/sigma AS pct_total, sigma - s AS delta_vol FROM (
 SELECT hw.name, sum(hw.weight) AS weight, sum(contribution*hw.weight/rt.weight) AS contribution FROM hw JOIN rt USING (ticker) GROUP BY 1) JOIN ({_left_out('name')}) ON k = name, sig""")
def risk_by_portfolio(spark, sf):
    return risk_model(spark, sf).by_portfolio()


@query("risk_headline", "book_id top_ticker", nums="total_contribution top_contribution sigma sigma_without_top",
       sql=f"""SELECT 'current' AS book_id, sum(contribution) AS total_contribution, arg_max(ticker, contribution) AS top_ticker, max(contribution) AS top_contribution,
 (SELECT sigma FROM sig) AS sigma, arg_max(s, contribution) AS sigma_without_top FROM rt JOIN ({_left_out('ticker')}) ON k = ticker""")
def risk_headline(spark, sf):
    return risk_model(spark, sf).headline()


define("series_all", "SELECT name, ts, ret FROM panel UNION ALL SELECT 'Combined book', ts, ret FROM book_ret")
COMPARISON_SQL = f"""SELECT 'current' AS book_id, name, value, total_return, ann_return, ytd_return, sharpe, max_drawdown AS max_dd, ann_vol AS annualised_vol, n AS n_days
FROM ({metrics_sql('SELECT * FROM series_all', 'name')}) JOIN (SELECT name, product(1 + ret) - 1 AS ytd_return FROM series_all WHERE year(ts) = (SELECT max(year(ts)) FROM panel) GROUP BY name) USING (name)
JOIN (SELECT name, value_base AS value FROM pvalues UNION ALL SELECT 'Combined book', sum(value_base) FROM pvalues) USING (name)"""


def comparison(spark, sf):
    return settle(performance.benchmark_comparison(*panel_and_values(spark, sf), True, "1w"))


@query("benchmark_comparison", "book_id name", "n_days", "value total_return ann_return ytd_return sharpe max_dd annualised_vol", digits=4, sql=COMPARISON_SQL)
def benchmark_comparison(spark, sf):
    return comparison(spark, sf)


@query("benchmark_window", "book_id name", "n_days", "total_return max_dd annualised_vol", digits=4,
       sql=f"""SELECT 'current' AS book_id, name, total_return, max_drawdown AS max_dd, ann_vol AS annualised_vol, n AS n_days
FROM ({metrics_sql("SELECT * FROM series_all WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'", 'name')})""")
def benchmark_window(spark, sf):
    returns, worth = panel_and_values(spark, sf)
    return performance.benchmark_comparison(returns, worth, True, "1w", start="1997-01-01", end="1998-12-31")


@query("benchmark_deltas", "book_id name benchmark", nums="sharpe_delta max_dd_delta vol_delta",
       sql=f"""WITH c AS ({COMPARISON_SQL}) SELECT 'current' AS book_id, c.name, b.name AS benchmark, c.sharpe - b.sharpe AS sharpe_delta,
 c.max_dd - b.max_dd AS max_dd_delta, c.annualised_vol - b.annualised_vol AS vol_delta FROM c, c b WHERE b.name = 'EUROPE'""")
def benchmark_deltas(spark, sf):
    return performance.benchmark_deltas(comparison(spark, sf), t.portfolio(spark, sf))


@query("book_performance", "book_id", "n_days", "aum fx_rate ann_return ann_vol sharpe max_dd", digits=4,
       sql=f"""SELECT book_id, n AS n_days, (SELECT sum(value_base) FROM pvalues) AS aum, 1.3::DOUBLE AS fx_rate, ann_return, ann_vol, sharpe, max_drawdown AS max_dd
FROM ({metrics_sql('SELECT * FROM book_ret', 'book_id')})""")
def book_performance(spark, sf):
    return performance.book_performance(*panel_and_values(spark, sf), True, "1w")


@query("book_nav", "book_id ts", nums="nav",
       sql="SELECT book_id, ts, product(1 + ret) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)*100 AS nav FROM book_ret")
def book_nav(spark, sf):
    return performance.book_nav(rt.book_returns(*panel_and_values(spark, sf)), "1w")


@query("book_periods", "book_id period", "days", "cum_return ann_return ann_vol sharpe max_dd", sql=periods_sql("SELECT * FROM book_ret", "book_id"))
def book_periods(spark, sf):
    return performance.book_periods(rt.book_returns(*panel_and_values(spark, sf)), timeframe="1w")
