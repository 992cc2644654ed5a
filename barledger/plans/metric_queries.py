"""Queries over return series: capital models and performance metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.functions.ordered import Lane
from barledger.operators import capital, metrics, periods
from barledger.plans import tables as t
from barledger.plans.bar_queries import backtest
from barledger.plans.oracle_base import define
from barledger.plans.registry import query

METRICS = " ".join(metrics.METRIC_COLUMNS)


def week_returns(spark, sf):
    """Weekly close-to-close returns, one series per symbol."""
    return metrics.simple_returns(t.bars_week(spark, sf), Lane(("symbol",))).select("symbol", "ts", "ret")


define("week_ret", """SELECT symbol, ts, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars_week""")


def metrics_sql(source: str, key: str) -> str:
    """Metric set of (key, ts, ret) rows without nulls."""
    return f"""SELECT {key}, any_value(n) AS n, any_value(tot) AS total_return, any_value(ann) AS ann_return, any_value(vol) AS ann_vol,
  any_value(dv) AS downside_vol, any_value(CASE WHEN vol > 0 THEN mu*252/vol ELSE 0 END) AS sharpe,
  any_value(CASE WHEN dv > 0 THEN mu*252/dv ELSE 0 END) AS sortino,
  any_value(CASE WHEN mdd < 0 THEN ann/abs(mdd) ELSE 'infinity'::DOUBLE END) AS calmar,
  any_value(CASE WHEN ls > 0 THEN gs/ls ELSE 'infinity'::DOUBLE END) AS omega, any_value(mdd) AS max_drawdown, any_value(add) AS avg_drawdown,
  any_value(sk) AS skewness, any_value(ku) AS kurtosis, any_value(p05) AS var_95, avg(ret) FILTER (ret <= p05) AS cvar_95,
  any_value(CASE WHEN abs(p05) > 0 THEN abs(p95)/abs(p05) ELSE 'infinity'::DOUBLE END) AS tail_ratio
FROM (SELECT * FROM (SELECT *, pow(1 + tot, 252.0::DOUBLE/n) - 1 AS ann FROM (
  SELECT {key}, count(*) AS n, product(1 + ret) - 1 AS tot, avg(ret) AS mu, stddev_samp(ret)*sqrt(252) AS vol,
    CASE WHEN count(*) FILTER (ret < 0) = 0 THEN 0 ELSE stddev_samp(ret) FILTER (ret < 0)*sqrt(252) END AS dv,
    coalesce(sum(ret) FILTER (ret > 0), 0) AS gs, coalesce(-sum(ret) FILTER (ret < 0), 0) AS ls, min(g/k - 1) AS mdd,
    coalesce(avg(g/k - 1) FILTER (g/k - 1 < 0), 0) AS add,
    CASE WHEN count(*) >= 3 THEN CASE WHEN stddev_pop(ret) = 0 THEN 0 ELSE skewness(ret) END END AS sk,
    CASE WHEN count(*) >= 4 THEN CASE WHEN stddev_pop(ret) = 0 THEN 0 ELSE kurtosis(ret) END END AS ku,
    quantile_cont(ret, 0.05::DOUBLE) AS p05, quantile_cont(ret, 0.95::DOUBLE) AS p95
  FROM (SELECT *, max(g) OVER (PARTITION BY {key} ORDER BY ts) AS k FROM (
    SELECT *, product(1 + ret) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM ({source}))) GROUP BY {key}))
  JOIN ({source}) USING ({key})) GROUP BY {key}"""


@query("performance_metrics", "symbol", "n", METRICS, sql=metrics_sql("SELECT * FROM week_ret WHERE ret IS NOT NULL", "symbol"))
def performance_metrics(spark, sf):
    return metrics.performance(week_returns(spark, sf), ["symbol"], timeframe="1w")


# DuckDB multiplies windows in tree order, so on flat bars its equity can differ from the peak by one
# unit in the last place; 1e-12 separates that from a real fall.
for _p, _n in (("d20", "day"), ("s20", "supplier")):
    query(f"allocation_summary_{_n}", "symbol", "entries exits invested_days",
          "return_mtc return_conservative return_net pct_invested max_drawdown_mtc avg_drawdown_mtc max_drawdown_conservative avg_drawdown_conservative",
          sql=f"""SELECT symbol, arg_max(e_mtc, ts) - 1 AS return_mtc, arg_max(e_con, ts) - 1 AS return_conservative, arg_max(e_net, ts) - 1 AS return_net,
 sum(enter) AS entries, sum(leave) AS exits, count(*) FILTER (cycle <> 'None') AS invested_days,
 count(*) FILTER (cycle <> 'None')/count(*)::DOUBLE*100 AS pct_invested, min(e_mtc/km - 1) AS max_drawdown_mtc, min(e_con/kc - 1) AS max_drawdown_conservative,
 coalesce(avg(e_mtc/km - 1) FILTER (round(e_mtc/km - 1, 12) < 0), 0) AS avg_drawdown_mtc, coalesce(avg(e_con/kc - 1) FILTER (round(e_con/kc - 1, 12) < 0), 0) AS avg_drawdown_conservative
FROM (SELECT *, max(e_mtc) OVER w AS km, max(e_con) OVER w AS kc FROM {_p}_bt WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY symbol""")(
        lambda spark, sf, p=_p: capital.allocation_summary(*backtest(spark, sf, p)))


@query("equity_wide", "ts", nums="urgent high medium other low", sql="""SELECT ts, any_value(e_net) FILTER (symbol = '1-URGENT') AS urgent, any_value(e_net) FILTER (symbol = '2-HIGH') AS high,
 any_value(e_net) FILTER (symbol = '3-MEDIUM') AS medium, any_value(e_net) FILTER (symbol = '4-NOT SPECIFIED') AS other, any_value(e_net) FILTER (symbol = '5-LOW') AS low
FROM d20_bt GROUP BY ts""")
def equity_wide(spark, sf):
    bt, lane = backtest(spark, sf)
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "other", "5-LOW": "low"}
    return capital.equity_wide(bt, lane, list(names), "net").withColumnsRenamed(names)


# Sums over symbols are exact decimals on both sides, so that they do not depend on the order of rows.
CURVES = {
    "rebalanced": """SELECT ts, ret, product(1 + ret) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM (
  SELECT ts, coalesce(sum(CASE WHEN cycle <> 'None' THEN r_net END), 0)/(SELECT count(DISTINCT symbol) FROM d20_bt) AS ret FROM d20_bt GROUP BY ts)""",
    "buy_and_hold": """SELECT *, coalesce(equity/lag(equity) OVER (ORDER BY ts) - 1, 0) AS ret FROM (
 SELECT ts, CAST(sum(CAST(e_net AS DECIMAL(38,18))) AS DOUBLE)/count(e_net) AS equity FROM d20_bt GROUP BY ts)""",
    "fixed_stake": """SELECT *, coalesce(equity/lag(equity) OVER (ORDER BY ts) - 1, 0) AS ret FROM (
 SELECT ts, (stake + CAST(o + coalesce(sum(c) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))/stake AS equity FROM (SELECT *, 1000.0::DOUBLE*(SELECT count(DISTINCT symbol) FROM d20_bt) AS stake FROM (
  SELECT ts, sum(u) AS o, sum(CASE WHEN cycle = 'exit' THEN u ELSE 0 END) AS c FROM (
   SELECT b.ts, b.cycle, CAST(coalesce((g_net - 1)*1000, 0) AS DECIMAL(38,18)) AS u FROM d20_bt b LEFT JOIN d20_tr g USING (symbol, ts)) GROUP BY ts)))""",
}
for _mode, _sql in CURVES.items():
    query(f"portfolio_curve_{_mode}_blocked", "ts", nums="ret equity", sql=_sql)(
        lambda spark, sf, m=_mode: capital.portfolio_curve(*backtest(spark, sf), "net", m, block_rows=200, slice_rows=48))
    query(f"portfolio_curve_{_mode}", "ts", nums="ret equity", sql=_sql)(
        lambda spark, sf, m=_mode: capital.portfolio_curve(*backtest(spark, sf), "net", m))
    query(f"portfolio_metrics_{_mode}", "book", "n", METRICS, sql=metrics_sql(f"SELECT 'all' AS book, ts, ret FROM ({_sql})", "book"))(
        lambda spark, sf, m=_mode: metrics.performance(
            capital.portfolio_curve(*backtest(spark, sf), "net", m).withColumn("book", F.lit("all")), ["book"], timeframe="1d"))


query("performance_blocked", "symbol", "n", METRICS, sql=metrics_sql("SELECT * FROM week_ret WHERE ret IS NOT NULL", "symbol"))(
    lambda spark, sf: metrics.performance(week_returns(spark, sf), ["symbol"], timeframe="1w", block_rows=40, slice_rows=8))


@query("versus_benchmark", "symbol", nums="beta alpha information_ratio up_capture down_capture",
       sql="""WITH b AS (SELECT ts, ret AS bench FROM week_ret WHERE symbol = '1-URGENT' AND ret IS NOT NULL),
 j AS (SELECT symbol, ret, bench FROM week_ret LEFT JOIN b USING (ts) WHERE ret IS NOT NULL)
SELECT symbol, beta, own - beta*(pow(1 + (SELECT avg(bench) FROM b), 252) - 1) AS alpha, information_ratio, up_capture, down_capture FROM (
 SELECT symbol, covar_samp(ret, bench)/var_samp(CASE WHEN bench IS NOT NULL THEN bench END) AS beta, pow(product(1 + ret), 252.0::DOUBLE/count(*)) - 1 AS own,
  avg(ret - coalesce(bench, 0))*252/nullif(stddev_samp(ret - coalesce(bench, 0))*sqrt(252), 0) AS ir,
  coalesce(avg(ret - coalesce(bench, 0))*252/nullif(stddev_samp(ret - coalesce(bench, 0))*sqrt(252), 0), 0) AS information_ratio,
  avg(ret) FILTER (bench > 0)/avg(bench) FILTER (bench > 0) AS up_capture, avg(ret) FILTER (bench < 0)/avg(bench) FILTER (bench < 0) AS down_capture FROM j GROUP BY symbol)""")
def versus_benchmark(spark, sf):
    rets = week_returns(spark, sf)
    bench = rets.where((F.col("symbol") == "1-URGENT") & F.col("ret").isNotNull()).select("ts", F.col("ret").alias("bench"))
    return metrics.versus_benchmark(rets, bench, ["symbol"])


DD_SQL = """SELECT symbol, ts, g/max(g) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS drawdown FROM (
 SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM week_ret WHERE ret IS NOT NULL)"""


@query("drawdown_series", "symbol ts", nums="drawdown", sql=DD_SQL)
def drawdown_series(spark, sf):
    return metrics.drawdown_series(week_returns(spark, sf), ["symbol"], "1w")[0]


@query("longest_underwater", "symbol", nums="underwater_days",
       sql=f"""SELECT symbol, max(date_diff('second', a, b))/86400.0::DOUBLE AS underwater_days FROM (
 SELECT symbol, grp, min(ts) AS a, max(nxt) AS b FROM (SELECT *, drawdown < 0 AS under, lead(ts) OVER w AS nx, CASE WHEN drawdown < 0 AND NOT coalesce(lead(drawdown) OVER w < 0, true) THEN lead(ts) OVER w END AS nxt,
   sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER w AS grp FROM ({DD_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 WHERE under GROUP BY symbol, grp) GROUP BY symbol""")
def longest_underwater(spark, sf):
    return metrics.longest_underwater(week_returns(spark, sf), ["symbol"], "1w")


@query("rolling_sharpe", "symbol ts", nums="rolling_sharpe",
       sql="""SELECT symbol, ts, CASE WHEN count(ret) OVER w = 12 THEN avg(ret) OVER w * 252/nullif(stddev_samp(ret) OVER w * sqrt(252), 0) END AS rolling_sharpe
FROM week_ret WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_sharpe(spark, sf):
    return metrics.rolling_sharpe(week_returns(spark, sf), ["symbol"], 12, timeframe="1w")


@query("rolling_return", "symbol ts", nums="rolling_return",
       sql="""SELECT symbol, ts, CASE WHEN count(ret) OVER w = 8 THEN product(1 + ret) OVER w - 1 END AS rolling_return
FROM week_ret WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def rolling_return(spark, sf):
    return metrics.rolling_return(week_returns(spark, sf), ["symbol"], 8, timeframe="1w")


@query("monthly_table", "symbol", "year", " ".join(f"m{i}" for i in range(1, 13)),
       sql="""WITH m AS (SELECT symbol, date_trunc('month', ts)::DATE AS d, product(1 + ret) - 1 AS r FROM week_ret WHERE ret IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT symbol, unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH))::DATE AS d FROM m GROUP BY symbol)
SELECT symbol, year(d) AS year, """ + ", ".join(f"max(CASE WHEN month(d) = {i} THEN coalesce(r, 0) END) AS m{i}" for i in range(1, 13)) + """
FROM s LEFT JOIN m USING (symbol, d) GROUP BY 1, 2""")
def monthly_table(spark, sf):
    return metrics.monthly_table(week_returns(spark, sf), ["symbol"])


for _kind, _expr in (("simple", "c/p - 1"), ("log", "ln(c/p)")):
    query(f"panel_returns_{_kind}", "symbol ts", nums="ret",
          sql=f"""WITH cal AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS pts FROM (SELECT DISTINCT ts FROM bars_day))
SELECT a.symbol, a.ts, {_expr.replace('c/p', 'a.close/b.close')} AS ret FROM bars_day a JOIN cal USING (ts) LEFT JOIN bars_day b ON b.symbol = a.symbol AND b.ts = cal.pts""")(
        lambda spark, sf, k=_kind: metrics.panel_returns(t.bars_day(spark, sf), log=k == "log", timeframe="1d"))


@query("nav_normalised", "symbol ts", nums="close",
       sql="SELECT symbol, ts, close/first(close) OVER (PARTITION BY symbol ORDER BY ts)*100 AS close FROM bars_week")
def nav_normalised(spark, sf):
    return metrics.normalise_to(t.bars_week(spark, sf), ["symbol"], "close", 100.0)


@query("returns_describe", "symbol", "count", "mean std min q25 q50 q75 max",
       sql="""SELECT symbol, count(ret) AS count, avg(ret) AS mean, stddev_samp(ret) AS std, min(ret) AS min, quantile_cont(ret, 0.25::DOUBLE) AS q25,
 quantile_cont(ret, 0.5::DOUBLE) AS q50, quantile_cont(ret, 0.75::DOUBLE) AS q75, max(ret) AS max FROM week_ret GROUP BY symbol""")
def returns_describe(spark, sf):
    return metrics.describe(week_returns(spark, sf), ["symbol"], timeframe="1w")


def periods_sql(source: str, key: str, min_n: int = 5) -> str:
    return f"""SELECT {key}, period, CASE WHEN n >= {min_n} THEN tot END AS cum_return, CASE WHEN n >= {min_n} THEN pow(1 + tot, 252.0::DOUBLE/n) - 1 END AS ann_return,
 CASE WHEN n >= {min_n} THEN vol END AS ann_vol, CASE WHEN n >= {min_n} THEN CASE WHEN vol > 0 THEN mu*252/vol ELSE 0 END END AS sharpe,
 CASE WHEN n >= {min_n} THEN mdd END AS max_dd, n AS days
FROM (SELECT {key}, CASE WHEN period ~ '^[0-9]+$' AND (mn > make_date(period::BIGINT, 1, 8) OR (period::BIGINT = ly AND mx < make_date(period::BIGINT, 12, 24))) THEN period || ' (partial)' ELSE period END AS period, n, tot, mu, vol, mdd
 FROM (SELECT {key}, period, count(*) AS n, product(1 + ret) - 1 AS tot, avg(ret) AS mu, stddev_samp(ret)*sqrt(252) AS vol, min(g/k - 1) AS mdd, min(ts) AS mn, max(ts) AS mx, any_value(ly) AS ly
  FROM (SELECT *, max(g) OVER (PARTITION BY {key}, period ORDER BY ts) AS k FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {key}, period ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
   SELECT r.*, p.period FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC) AS rn, max(year(ts)) OVER (PARTITION BY {key}) AS ly FROM ({source})) r,
    LATERAL (SELECT period FROM (VALUES ('1M', 21), ('3M', 63), ('6M', 126), ('1Y', 252), ('All', 1000000000)) v(period, lim) WHERE rn <= lim UNION ALL SELECT year(r.ts)::VARCHAR) p)))
  GROUP BY {key}, period))"""


for _suffix, _layout in (("", {}), ("_blocked", {"block_rows": 60, "slice_rows": 8})):
    query(f"period_metrics{_suffix}", "symbol period", "days", "cum_return ann_return ann_vol sharpe max_dd",
          sql=periods_sql("SELECT * FROM week_ret WHERE ret IS NOT NULL", "symbol"))(
        lambda spark, sf, layout=_layout: periods.return_periods(week_returns(spark, sf), ["symbol"], timeframe="1w", **layout))


def nav_periods_sql(source: str, key: str) -> str:
    """Period table of (key, ts, nav) rows."""
    return f"""WITH nav AS (SELECT {key}, ts, nav, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC) AS rn, max(year(ts)) OVER (PARTITION BY {key}) AS ly FROM ({source})),
 m AS (SELECT n.*, p.period, p.kind FROM nav n, LATERAL (
   SELECT period, 'w' AS kind FROM (VALUES ('1M', 30), ('3M', 90), ('6M', 180), ('1Y', 365), ('All', 1000000000)) v(period, lim) WHERE rn <= lim
   UNION ALL SELECT 'YTD', 's' WHERE year(n.ts) = ly UNION ALL SELECT 'Since stmt', 's' WHERE n.ts >= TIMESTAMP '2000-06-30'
   UNION ALL SELECT year(n.ts)::VARCHAR, 'y') p),
 r AS (SELECT *, nav/lag(nav) OVER (PARTITION BY {key}, period ORDER BY ts) - 1 AS ret FROM m),
 g AS (SELECT *, product(1 + ret) OVER (PARTITION BY {key}, period ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM r),
 k AS (SELECT *, max(CASE WHEN ret IS NOT NULL THEN g END) OVER (PARTITION BY {key}, period ORDER BY ts) AS k FROM g),
 a AS (SELECT {key}, period, any_value(kind) AS kind, count(*) AS n, arg_max(nav, ts)/arg_min(nav, ts) - 1 AS cum, pow(product(1 + ret), 252.0::DOUBLE/nullif(count(ret), 0)) - 1 AS ann, avg(ret) AS mu,
   stddev_samp(ret)*sqrt(252) AS vol, min(CASE WHEN ret IS NOT NULL THEN g/k - 1 END) AS mdd, min(ts) AS mn, max(ts) AS mx, any_value(ly) AS ly FROM k GROUP BY 1, 2)
SELECT {key}, CASE WHEN kind = 'w' OR period = 'YTD' THEN period || ' (since ' || mn::DATE || ')' WHEN period = 'Since stmt' THEN 'Since stmt (2000-06-30)'
   WHEN mn > make_date(period::BIGINT, 1, 8) OR (period::BIGINT = ly AND mx < make_date(period::BIGINT, 12, 24)) THEN period || ' (partial)' ELSE period END AS period,
  CASE WHEN n >= 2 THEN cum END AS cum_return, CASE WHEN n >= 2 THEN ann END AS ann_return, CASE WHEN n >= 2 THEN vol END AS ann_vol,
  CASE WHEN n >= 2 THEN CASE WHEN vol > 0 THEN mu*252/vol ELSE 0 END END AS sharpe, CASE WHEN n >= 2 THEN mdd END AS max_dd, n AS days
FROM a WHERE n >= 2 OR kind <> 's'"""


def _week_navs(spark, sf):
    return t.bars_week(spark, sf).select("symbol", "ts", F.col("close").alias("nav"), F.lit(t.STATEMENT_DATE).cast("date").alias("statement_date"))


for _suffix, _layout in (("", {}), ("_blocked", {"block_rows": 60, "slice_rows": 8})):
    query(f"nav_period_metrics{_suffix}", "symbol period", "days", "cum_return ann_return ann_vol sharpe max_dd",
          sql=nav_periods_sql("SELECT symbol, ts, close AS nav FROM bars_week", "symbol"))(
        lambda spark, sf, layout=_layout: periods.nav_periods(_week_navs(spark, sf), ["symbol"], timeframe="1w", **layout))
