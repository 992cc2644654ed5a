"""Queries over bars: sources, signal, backtest and trade analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barledger.operators import fills, signals, trades
from barledger.plans import tables as t
from barledger.plans.oracle_base import define, summary_sql
from barledger.plans.registry import query
from barledger.session import settle, work_folder
from barledger.sources import bars as src, providers

COST_BPS = 5.0
#: Bar width by the first letter of a shared backtest.
WIDTHS = {"d": "1d", "w": "1w", "h": "1h", "s": "1d"}
OHLCV = "open high low close volume"
STAT_COLUMNS = " ".join(
    f"return_{m} max_intra_drawdown_{m} d5_{m} d5_to_exit_{m}" for m in ("net", "mtc", "conservative")
)
SUMMARY = " ".join(trades.SUMMARY_COLUMNS)


def backtest(spark, sf, name="d20"):
    """Backtests shared by several queries: prefix letter is the bar table, number the window."""
    make, frame, window, trim = {
        "d20": (t.bars_day, "1d", 20, None),
        "d20t": (t.bars_day, "1d", 20, "1997-01-01"),
        "w10": (t.bars_week, "1w", 10, None),
        "w30": (t.bars_week, "1w", 30, None),
        "h24": (t.bars_hour, "1h", 24, None),
        "s20": (t.bars_supplier, "1d", 20, None),
    }[name]
    return fills.run_backtest(make(spark, sf), window, COST_BPS, trim_start=trim, timeframe=frame)


def stats(spark, sf, name="d20", **kw):
    return trades.trade_stats(*backtest(spark, sf, name), **kw)


for _name, _make in (("day", t.bars_day), ("week", t.bars_week), ("hour", t.bars_hour), ("supplier", t.bars_supplier)):
    query(f"resample_{_name}", "symbol ts", nums=OHLCV, sql=f"SELECT * FROM bars_{_name}")(
        lambda spark, sf, make=_make: make(spark, sf)
    )


for _name, _frame in (("5m", "5m"), ("15m", "15m"), ("30m", "30m"), ("4h", "4h"), ("month", "1mo")):
    query(f"resample_{_name}", "symbol ts", nums=OHLCV, sql=f"SELECT * FROM bars_{_name}")(
        lambda spark, sf, frame=_frame: t.bars_from_events(spark, sf, frame)
    )


@query("provider_bars", "symbol ts", nums=OHLCV,
       sql="SELECT * FROM bars_supplier WHERE symbol LIKE '1%' AND symbol IN (SELECT s_suppkey::VARCHAR FROM supplier) AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1996-12-31'")
def provider_bars(spark, sf):
    """Bars of all suppliers through the Parquet sink, read back by the folder provider with pushed filters."""
    folder = f"{work_folder(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    providers.write_bars(t.bars_supplier(spark, sf), folder)
    bars = src.between(providers.load(spark, providers.FolderProvider(folder)), "1996-01-01", "1996-12-31")
    return bars.where(F.col("symbol").startswith("1"))


@query("provider_priority", "symbol ts", "priority", OHLCV,
       sql="SELECT *, CASE WHEN symbol IN ('1-URGENT', '3-MEDIUM') THEN 2 ELSE 1 END AS priority FROM (SELECT * FROM bars_week WHERE symbol IN ('1-URGENT', '3-MEDIUM') UNION ALL SELECT * FROM bars_day WHERE symbol NOT IN ('1-URGENT', '3-MEDIUM'))")
def provider_priority(spark, sf):
    """Two providers; the second is asked for what the first does not have."""
    root = f"{work_folder(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    providers.write_bars(t.bars_week(spark, sf).where(F.col("symbol").isin("1-URGENT", "3-MEDIUM")), f"{root}/first")
    providers.write_bars(t.bars_day(spark, sf), f"{root}/second")
    return providers.load_first(spark, [providers.FolderProvider(f"{root}/{n}") for n in ("first", "second")])


# How the bar files of a symbol are written, in turn: kind, and the header in file order.
FILE_LAYOUTS = (
    ("parquet", "Date open high low close volume"), ("csv", "timestamp volume close low high open"),
    ("parquet", "timestamp close high low open volume"), ("csv", "DATE Open High Low Close Volume"),
)


@query("bars_from_files", "symbol ts", nums=OHLCV, sql="SELECT * FROM bars_day")
def bars_from_files(spark, sf):
    """One bar file per order priority, in four layouts, read back by symbol."""
    bars = settle(t.bars_day(spark, sf))
    folder = f"{work_folder(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    symbols = sorted(r["symbol"] for r in bars.select("symbol").distinct().collect())  # order priorities: a fixed handful
    for n, symbol in enumerate(symbols):
        kind, header = FILE_LAYOUTS[n % len(FILE_LAYOUTS)]
        own = bars.where(F.col("symbol") == symbol)
        cols = [F.col("ts" if c.lower() in src.TIME_COLUMN_NAMES else c.lower()).alias(c) for c in header.split()]
        own.select(*cols).write.format(kind).option("header", True).save(f"{folder}/{symbol}.{kind}")
    return src.read_bars(spark, folder, symbols)


@query("bars_date_range", "symbol ts", nums=OHLCV,
       sql="SELECT * FROM bars_day WHERE ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'")
def bars_date_range(spark, sf):
    return src.between(t.bars_day(spark, sf), "1998-01-01", "1998-12-31")


@query("bars_trim_to_end", "symbol ts", nums=OHLCV,
       sql="SELECT * FROM bars_hour WHERE ts < TIMESTAMP '2024-01-15'")
def bars_trim_to_end(spark, sf):
    from datetime import date

    return src.trim_to_end(t.bars_hour(spark, sf), date(2024, 1, 14))


@query("latest_bars", "symbol ts", nums=OHLCV,
       sql="SELECT * FROM bars_day QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3")
def latest_bars(spark, sf):
    return src.latest_bars(t.bars_day(spark, sf), 3)


@query("source_priority", "symbol ts", "priority", OHLCV,
       sql="""WITH a AS (SELECT *, 10 AS priority FROM bars_week WHERE symbol IN ('1-URGENT', '5-LOW')),
  b AS (SELECT *, 1 AS priority FROM bars_day)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE symbol NOT IN (SELECT symbol FROM a)""")
def source_priority(spark, sf):
    weekly = t.bars_week(spark, sf).where(F.col("symbol").isin("1-URGENT", "5-LOW"))
    return src.prefer_sources([(10, weekly), (1, t.bars_day(spark, sf))])


@query("symbol_search", "symbol", sql="SELECT DISTINCT symbol FROM bars_day WHERE symbol LIKE '%GE%' OR symbol LIKE '%ge%'")
def symbol_search(spark, sf):
    return src.search_symbols(t.bars_day(spark, sf), "ge")


@query("index_members", "symbol", sql="SELECT n_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def index_members(spark, sf):
    nation, region = t.table(spark, sf, "nation"), t.table(spark, sf, "region")
    members = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return src.index_members(members.select(F.col("r_name").alias("index_name"), F.col("n_name").alias("symbol")), "ASIA")


SIGNAL_INTS = "signal_close signal_open trade_direction turnover enter exit_bar signal_age"


def _signal_query(name, make, frame, window, prefix, trim=None):
    @query(name, "symbol ts cycle", SIGNAL_INTS, "close ma", 8,
           sql=f"SELECT *, leave AS exit_bar FROM {prefix}_sig")
    def run(spark, sf):
        frame_df, _ = signals.run_trend_signal(make(spark, sf), window, trim, timeframe=frame)
        return frame_df.withColumnRenamed("exit", "exit_bar")


_signal_query("trend_signal_day", t.bars_day, "1d", 20, "d20")
_signal_query("trend_signal_trimmed", t.bars_day, "1d", 20, "d20t", "1997-01-01")
_signal_query("trend_signal_hour", t.bars_hour, "1h", 24, "h24")


@query("signal_on_intervals", "symbol on_from on_to",
       sql="""SELECT symbol, min(CASE WHEN signal_open = 1 THEN ts END) AS on_from, coalesce(min(CASE WHEN leave = 1 THEN ts END), max(last_ts)) AS on_to
FROM (SELECT *, sum(enter) OVER (PARTITION BY symbol ORDER BY ts) AS run, max(ts) OVER (PARTITION BY symbol) AS last_ts FROM d20_sig)
WHERE cycle <> 'None' GROUP BY symbol, run""")
def signal_on_intervals(spark, sf):
    return signals.on_intervals(*signals.run_trend_signal(t.bars_day(spark, sf), 20, timeframe="1d"))


BACKTEST_NUMS = (
    "return_mark_to_close return_conservative return_net strategy_equity_mark_to_close "
    "strategy_equity_conservative strategy_equity_net"
)
BACKTEST_SQL = """SELECT symbol, ts, cycle, r_mtc AS return_mark_to_close, r_con AS return_conservative, r_net AS return_net,
  e_mtc AS strategy_equity_mark_to_close, e_con AS strategy_equity_conservative, e_net AS strategy_equity_net,
  ps AS position_start, CASE WHEN cycle IN ('init','held') THEN 1 ELSE 0 END AS position_end, cid AS trade_cycle_id FROM {0}_bt"""


@query("bar_backtest_day", "symbol ts cycle", "position_start position_end trade_cycle_id", BACKTEST_NUMS,
       sql=BACKTEST_SQL.format("d20"))
def bar_backtest_day(spark, sf):
    return backtest(spark, sf)[0]


define("ranked", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars_hour")


@query("bar_backtest_hour_blocked", "symbol ts cycle", "position_start position_end trade_cycle_id", BACKTEST_NUMS,
       sql=BACKTEST_SQL.format("h24"))
def bar_backtest_hour_blocked(spark, sf):
    """The layout for long series: blocks of 200 hours with borrowed rows and carries."""
    return fills.run_backtest(
        t.bars_hour(spark, sf), 24, COST_BPS, timeframe="1h", block_rows=200, slice_rows=48
    )[0]


@query("bar_backtest_delayed", "symbol ts cycle", "enter exit_bar signal_open", "return_mark_to_close return_net",
       sql="""WITH run AS (SELECT *, sum(enter) OVER (PARTITION BY symbol ORDER BY ts) AS run_no FROM d20_sig),
 pos AS (SELECT *, CASE WHEN cycle <> 'None' THEN row_number() OVER p - 1 END AS spot, CASE WHEN cycle <> 'None' THEN count(*) OVER q END AS len
   FROM run WINDOW p AS (PARTITION BY symbol, run_no, cycle <> 'None' ORDER BY ts), q AS (PARTITION BY symbol, run_no, cycle <> 'None')),
 cut AS (SELECT symbol, ts, open, high, low, close, spot IS NOT NULL AND (len <= 3 OR spot < 2) AS flat, coalesce(spot = 2 AND len > 3, false) AS fresh,
   cycle AS c0, enter AS e0, leave AS x0, signal_open AS s0 FROM pos),
 fin AS (SELECT symbol, ts, open, high, low, close, CASE WHEN flat THEN 'None' WHEN fresh THEN 'init' ELSE c0 END AS cycle,
   CASE WHEN flat THEN 0 WHEN fresh THEN 1 ELSE e0 END AS enter, CASE WHEN flat THEN 0 ELSE x0 END AS exit_bar,
   CASE WHEN flat OR fresh THEN 0 ELSE s0 END AS signal_open, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM cut)
SELECT *, r AS return_mark_to_close, r - CASE WHEN cycle IN ('init','exit') THEN 0.0005::DOUBLE ELSE 0 END AS return_net FROM (
  SELECT *, CASE cycle WHEN 'init' THEN close/open - 1 WHEN 'exit' THEN open/pc - 1 WHEN 'held' THEN close/pc - 1 ELSE 0 END AS r FROM fin)""")
def bar_backtest_delayed(spark, sf):
    out, _ = fills.run_backtest(t.bars_day(spark, sf), 20, COST_BPS, entry_offset=2, timeframe="1d")
    return out.withColumnRenamed("exit", "exit_bar")


for _name, _prefix in (("day", "d20"), ("trimmed", "d20t"), ("supplier", "s20")):
    query(f"trade_stats_{_name}", "symbol label entry_date exit_date", "duration", STAT_COLUMNS,
          sql=f"SELECT * FROM {_prefix}_stats")(lambda spark, sf, p=_prefix: stats(spark, sf, p))

for _name, _prefix, _method in (("net", "d20", "net"), ("conservative", "d20", "conservative"), ("supplier", "s20", "net")):
    query(f"trade_summary_{_name}", "symbol", "n_trades", SUMMARY,
          sql=summary_sql(f"{_prefix}_stats", "symbol", f"return_{_method}", f"max_intra_drawdown_{_method}"))(
        lambda spark, sf, p=_prefix, m=_method: trades.trade_summary(stats(spark, sf, p), m, timeframe=WIDTHS[p[0]])
    )


def variants(spark, sf):
    """Two moving-average windows as variants of one job over one scan: the key travels through every operator."""
    bt, lane = fills.run_sweep(t.bars_week(spark, sf), {"w10": 10, "w30": 30}, COST_BPS, timeframe="1w")
    return settle(trades.trade_stats(bt, lane))


VARIANT_TRADES = "(SELECT 'w10' AS variant, * FROM w10_stats UNION ALL SELECT 'w30' AS variant, * FROM w30_stats)"


@query("variant_pooled", "variant", "n_trades", SUMMARY,
       sql=summary_sql(VARIANT_TRADES, "variant", "return_net", "max_intra_drawdown_net", "mx"))
def variant_pooled(spark, sf):
    return trades.pooled_table(variants(spark, sf))


@query("variant_symbol", "variant symbol", "n_trades", SUMMARY,
       sql=summary_sql(VARIANT_TRADES, "variant, symbol", "return_net", "max_intra_drawdown_net"))
def variant_symbol(spark, sf):
    return trades.symbol_table(variants(spark, sf), timeframe="1w")


SWEEP = (5, 8, 10, 13, 20, 30, 45, 60, 90, 150)


@query("variant_sweep_blocked", "variant", "n_bars n_long n_entries", "last_equity",
       sql=f"""SELECT 'ma' || n AS variant, count(*) AS n_bars, sum(on_) AS n_long, sum(CASE WHEN on_ = 1 AND p = 0 THEN 1 ELSE 0 END) AS n_entries, arg_max(e, (ts, symbol)) AS last_equity FROM (
 SELECT *, product(1 + CASE WHEN on_ = 1 AND p = 0 THEN close/open - 1 WHEN on_ = 0 AND p = 1 THEN open/pc - 1 WHEN on_ = 1 THEN close/pc - 1 ELSE 0 END
   - CASE WHEN on_ <> p THEN {COST_BPS}::DOUBLE/10000 ELSE 0 END) OVER (PARTITION BY n, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS e FROM (
  SELECT *, lag(on_, 1, 0) OVER (PARTITION BY n, symbol ORDER BY ts) AS p, lag(close) OVER (PARTITION BY n, symbol ORDER BY ts) AS pc FROM (
   SELECT *, lag(CASE WHEN close > ma THEN 1 ELSE 0 END, 1, 0) OVER (PARTITION BY n, symbol ORDER BY ts) AS on_ FROM (
    SELECT b.*, n, CASE WHEN b.k >= n THEN (SELECT avg(x.close) FROM ranked x WHERE x.symbol = b.symbol AND x.k > b.k - n AND x.k <= b.k) END AS ma FROM ranked b, (SELECT unnest([{', '.join(map(str, SWEEP))}]) AS n))))) GROUP BY n""")
def variant_sweep_blocked(spark, sf):
    """Ten averaging lengths over hourly bars in blocks."""
    bt, lane = fills.run_sweep(t.bars_hour(spark, sf), {f"ma{n}": n for n in SWEEP}, COST_BPS, timeframe="1h", block_rows=400, slice_rows=48)
    return bt.groupBy("variant").agg(
        F.count("*").alias("n_bars"), F.sum("signal_open").alias("n_long"), F.sum("enter").alias("n_entries"),
        F.max_by("strategy_equity_net", F.struct("ts", "symbol")).alias("last_equity"))


TIMING_SQL = """SELECT {keys}, count(*) FILTER (duration >= 5 AND d5 > 0)/nullif(count(*) FILTER (duration >= 5), 0)::DOUBLE AS wr_d5,
 count(*) FILTER (duration >= 5) AS wr_d5_n, count(*) FILTER (duration >= 5 AND d5 > 0) AS wr_d5_nwin,
 count(*) FILTER (duration > 5 AND tail > 0)/nullif(count(*) FILTER (duration > 5), 0)::DOUBLE AS wr_tail,
 count(*) FILTER (duration > 5) AS wr_tail_n, count(*) FILTER (duration > 5 AND tail > 0) AS wr_tail_nwin FROM {src} GROUP BY {keys}"""
TIMING_INTS = "wr_d5_n wr_d5_nwin wr_tail_n wr_tail_nwin"


@query("trade_timing", "symbol", TIMING_INTS, "wr_d5 wr_tail",
       sql=TIMING_SQL.format(keys="symbol", src="(SELECT symbol, duration, d5_net AS d5, d5_to_exit_net AS tail FROM d20_stats)"))
def trade_timing(spark, sf):
    return trades.d5_stats(stats(spark, sf))


_LONG = "(" + " UNION ALL ".join(
    f"SELECT symbol, '{m}' AS method, duration, return_{m} AS ret, max_intra_drawdown_{m} AS dd, d5_{m} AS d5, d5_to_exit_{m} AS tail FROM d20_stats"
    for m in ("net", "conservative")) + ")"


@query("quality_table", "symbol method flag_text " + " ".join(trades.FLAG_NAMES), "n_trades " + TIMING_INTS, SUMMARY + " wr_d5 wr_tail",
       sql=f"""SELECT *, CASE WHEN txt = '' THEN '—' ELSE txt END AS flag_text FROM (SELECT *, concat_ws(', ', CASE WHEN median_negative THEN 'median < 0' END, CASE WHEN top_trade_outlier THEN 'top trade > 30%' END,
  CASE WHEN skewed_right THEN 'right-skewed' WHEN skewed_left THEN 'left-skewed' END,
  CASE WHEN edge_reversed THEN 'edge reverses' WHEN fill_halves_edge THEN 'fill halves edge' END, CASE WHEN median_flips THEN 'median flips' END) AS txt FROM (
 SELECT s.*, m.* EXCLUDE (symbol, method), coalesce(s.expectancy > 0 AND s.median_return < 0, false) AS median_negative,
  coalesce(s.expectancy > 0 AND abs(s.expectancy - s.expectancy_ex_top)/abs(s.expectancy) > 0.3, false) AS top_trade_outlier,
  coalesce(s.skewness > 1.5, false) AS skewed_right, coalesce(s.skewness < -1.5, false) AS skewed_left,
  s.method <> 'net' AND n.expectancy > 0 AND s.expectancy <= 0 AS edge_reversed,
  s.method <> 'net' AND n.expectancy > 0 AND s.expectancy > 0 AND s.expectancy < n.expectancy * 0.5 AS fill_halves_edge,
  s.method <> 'net' AND n.median_return >= 0 AND s.median_return < 0 AS median_flips
 FROM ({summary_sql(_LONG, 'symbol, method', 'ret', 'dd')}) s
 JOIN ({TIMING_SQL.format(keys='symbol, method', src=_LONG)}) m USING (symbol, method)
 JOIN ({summary_sql('d20_stats', 'symbol', 'return_net', 'max_intra_drawdown_net')}) n ON n.symbol = s.symbol))""")
def quality_table(spark, sf):
    table = trades.quality_table(stats(spark, sf), timeframe="1d")
    return table.withColumn("flag_text", trades.flag_text())


PATHS_SQL = """SELECT symbol, cid, bar_no, g_net - 1 AS cum_net, g_con - 1 AS cum_con FROM d20_tr
UNION ALL SELECT symbol, cid, 0, 0, 0 FROM d20_tr WHERE bar_no = 1"""


@query("trade_paths", "symbol label", "bar_no", "cum_net cum_con",
       sql=f"SELECT p.*, label FROM ({PATHS_SQL}) p JOIN d20_stats s USING (symbol, cid)")
def trade_paths(spark, sf):
    return trades.trade_paths(*backtest(spark, sf))


@query("path_envelope", "symbol", "bar_no n_open", "mean median std",
       sql=f"SELECT symbol, bar_no, count(*) AS n_open, avg(cum_net) AS mean, quantile_cont(cum_net, 0.5::DOUBLE) AS median, stddev_pop(cum_net) AS std FROM ({PATHS_SQL}) GROUP BY 1, 2")
def path_envelope(spark, sf):
    return trades.path_envelope(settle(trades.trade_paths(*backtest(spark, sf))))
