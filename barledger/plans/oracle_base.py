"""Shared tables of the DuckDB side, in dependency order."""

from __future__ import annotations

TABLES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    TABLES[name] = sql


def with_tables(names: list[str], body: str) -> str:
    """``body`` preceded by the named tables and everything they mention."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for other, sql in TABLES.items():
            if other not in needed and _mentions(text, other):
                needed.add(other)
                visit(sql)

    visit(body)
    for n in names:
        if n not in needed:
            needed.add(n)
            visit(TABLES[n])
    parts = [f"{n} AS (\n{sql}\n)" for n, sql in TABLES.items() if n in needed]
    return (f"WITH {', '.join(parts)}\n{body}") if parts else body


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(w == name or w.startswith(name + ".") for w in words)


def _bars(source: str, symbol: str, slot: str, price: str, order: str) -> str:
    return f"""SELECT {symbol} AS symbol, {slot} AS ts,
  arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low,
  arg_max({price}, {order}) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM {source} GROUP BY ALL"""


_ORDER_PRICE = "1000.0::DOUBLE + o_totalprice/10000.0::DOUBLE"
define("bars_day", _bars("orders", "o_orderpriority", "date_trunc('day', o_orderdate)::TIMESTAMP", _ORDER_PRICE, "o_orderkey"))
define("bars_week", _bars("orders", "o_orderpriority", "date_trunc('week', o_orderdate)::TIMESTAMP", _ORDER_PRICE, "o_orderkey"))
define("bars_hour", _bars("events", "event_type", "date_trunc('hour', ts)::TIMESTAMP",
                          "100.0::DOUBLE + value/100.0::DOUBLE", "{'a': events.ts, 'b': event_id}"))
for _name, _slot in (("5m", "time_bucket(INTERVAL '5 minutes', ts)"), ("15m", "time_bucket(INTERVAL '15 minutes', ts)"),
                     ("30m", "time_bucket(INTERVAL '30 minutes', ts)"), ("4h", "time_bucket(INTERVAL '4 hours', ts)"), ("month", "date_trunc('month', ts)")):
    define(f"bars_{_name}", _bars("events", "event_type", f"{_slot}::TIMESTAMP", "100.0::DOUBLE + value/100.0::DOUBLE", "{'a': events.ts, 'b': event_id}"))
define("bars_supplier", _bars("lineitem", "l_suppkey::VARCHAR", "date_trunc('day', l_shipdate)::TIMESTAMP",
                              "1000.0::DOUBLE + l_extendedprice/10000.0::DOUBLE",
                              "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice}"))
define("region_orders", """SELECT r_name, o_orderpriority, o_orderdate, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
define("holding", """SELECT r_name AS name, o_orderpriority AS ticker, sum(o_totalprice) AS value,
  sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY r_name) AS weight
FROM region_orders WHERE o_orderdate < TIMESTAMP '2000-07-01' GROUP BY 1, 2""")
define("portfolio", """SELECT h.name, any_value(r_regionkey) AS ord, DATE '2000-06-30' AS statement_date,
  sum(value) AS total_value, CASE WHEN h.name IN ('AMERICA','ASIA') THEN 'USD' ELSE 'SGD' END AS currency,
  ['holding', CASE h.name WHEN 'EUROPE' THEN 'managed_benchmark' WHEN 'ASIA' THEN 'protected' ELSE 'custom' END] AS roles,
  CASE h.name WHEN 'EUROPE' THEN 0.005::DOUBLE ELSE 0.0::DOUBLE END AS fee_annual,
  CASE WHEN h.name IN ('AMERICA','ASIA') THEN 1.3::DOUBLE END AS statement_fx
FROM holding h JOIN region ON r_name = h.name GROUP BY h.name""")
define("universe", """SELECT * FROM (VALUES ('1-URGENT','Equity','US','Technology'), ('2-HIGH','Equity','Japan',NULL),
 ('3-MEDIUM','Bond','US','Treasury'), ('4-NOT SPECIFIED','Commodity','Global','Gold'),
 ('5-LOW','Cash','Singapore','Money Market')) AS u(ticker, asset_class, region, sector)""")
define("target_weight", """SELECT r_name AS name, DATE '2001-01-01' AS eff_date, o_orderpriority AS ticker,
  sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY r_name) AS weight
FROM region_orders WHERE o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY r_name, o_orderpriority""")
define("fx", """SELECT l_shipdate AS ts, 1.30::DOUBLE + (avg(l_discount) - 0.05::DOUBLE) / 10 AS rate
FROM lineitem GROUP BY 1""")
define("deposit", """SELECT r_name AS name, o_orderdate::DATE AS date, sum(o_totalprice) / 100 AS amount, 'SGD' AS currency
FROM region_orders WHERE o_orderdate BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2001-06-30' GROUP BY ALL""")


def define_signal(prefix: str, bars: str, window: int, cost_bps: float = 5.0, trim: str | None = None) -> None:
    """Signal, backtest and trade tables for one bar table, as ``<prefix>_sig/_bt/_tr/_stats``."""
    where = f"WHERE ts >= TIMESTAMP '{trim}'" if trim else ""
    define(f"{prefix}_base", f"""SELECT *, lag(signal_close, 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS signal_open FROM (
  SELECT *, CASE WHEN close > ma THEN 1 ELSE 0 END AS signal_close FROM (
    SELECT *, CASE WHEN count(close) OVER f = {window} THEN avg(close) OVER f END AS ma FROM {bars}
    WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)))""")
    define(f"{prefix}_sig", f"""SELECT *, CASE WHEN enter = 1 THEN 'init' WHEN leave = 1 THEN 'exit' WHEN signal_open = 1 THEN 'held' ELSE 'None' END AS cycle,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) - coalesce(max(CASE WHEN signal_open = 0 AND leave = 0 THEN n END)
    OVER (PARTITION BY symbol ORDER BY ts), 0) AS signal_age
FROM (SELECT *, signal_open - p AS trade_direction, abs(signal_open - p) AS turnover,
  CASE WHEN signal_open = 1 AND p = 0 THEN 1 ELSE 0 END AS enter, CASE WHEN signal_open = 0 AND p = 1 THEN 1 ELSE 0 END AS leave
  FROM (SELECT *, lag(signal_open, 1, 0) OVER w AS p, row_number() OVER w AS n FROM {prefix}_base {where}
        WINDOW w AS (PARTITION BY symbol ORDER BY ts)))""")
    define(f"{prefix}_bt", f"""SELECT *, product(1 + r_mtc) OVER w AS e_mtc, product(1 + r_con) OVER w AS e_con, product(1 + r_net) OVER w AS e_net,
  sum(CASE WHEN ps_prev IS NULL OR (ps_prev = 1 AND ps = 0) OR (ps = 0 AND ps_next = 1) THEN 1 ELSE 0 END) OVER w AS cid
FROM (SELECT *, lag(ps) OVER o AS ps_prev, lead(ps) OVER o AS ps_next, r_mtc - CASE WHEN cycle IN ('init','exit') THEN {cost_bps}::DOUBLE/10000 ELSE 0 END AS r_net
  FROM (SELECT *, CASE WHEN cycle IN ('exit','held') THEN 1 ELSE 0 END AS ps,
    CASE cycle WHEN 'init' THEN close/open - 1 WHEN 'exit' THEN open/pc - 1 WHEN 'held' THEN close/pc - 1 ELSE 0.0::DOUBLE END AS r_mtc,
    CASE cycle WHEN 'init' THEN close/high - 1 WHEN 'exit' THEN low/pc - 1 WHEN 'held' THEN close/pc - 1 ELSE 0.0::DOUBLE END AS r_con
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM {prefix}_sig))
  WINDOW o AS (PARTITION BY symbol ORDER BY ts))
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
    growth = ", ".join(f"product(1 + r_{m}) OVER w AS g_{m}" for m in ("net", "mtc", "con"))
    define(f"{prefix}_tr", f"""SELECT *, greatest(1.0, max(g_net) OVER w) AS k_net, greatest(1.0, max(g_mtc) OVER w) AS k_mtc, greatest(1.0, max(g_con) OVER w) AS k_con FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, cid ORDER BY ts) AS bar_no, {growth} FROM {prefix}_bt WHERE cycle <> 'None'
  WINDOW w AS (PARTITION BY symbol, cid ORDER BY ts ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY symbol, cid ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
    cols = ", ".join(
        f"""product(1 + r_{m}) - 1 AS return_{n}, least(0, min(g_{m}/k_{m} - 1)) AS max_intra_drawdown_{n},
  product(CASE WHEN bar_no <= 5 THEN 1 + r_{m} END) - 1 AS d5_{n},
  coalesce(product(CASE WHEN bar_no > 5 THEN 1 + r_{m} END), 1) - 1 AS d5_to_exit_{n}"""
        for m, n in (("net", "net"), ("mtc", "mtc"), ("con", "conservative"))
    )
    define(f"{prefix}_stats", f"""SELECT *, symbol || ' T' || row_number() OVER (PARTITION BY symbol ORDER BY entry_date) AS label FROM (
  SELECT symbol, cid, min(ts) AS entry_date, max(ts) AS exit_date, count(*) AS duration, {cols}
  FROM {prefix}_tr GROUP BY symbol, cid)""")


for _p, _b, _w, _t in (
    ("d20", "bars_day", 20, None), ("d20t", "bars_day", 20, "1997-01-01"), ("w10", "bars_week", 10, None),
    ("w30", "bars_week", 30, None), ("h24", "bars_hour", 24, None), ("s20", "bars_supplier", 20, None),
):
    define_signal(_p, _b, _w, trim=_t)


def summary_sql(source: str, keys: str, ret: str, dd: str, ex_top_single: str = "NULL") -> str:
    return f"""SELECT {keys}, count(*) AS n_trades, wr AS win_rate, aw AS avg_win, al AS avg_loss, wr*aw + (1-wr)*al AS expectancy,
  CASE WHEN n > 1 THEN ({'sr'} - mx)/(n-1) ELSE {ex_top_single} END AS expectancy_ex_top, med AS median_return,
  CASE WHEN sl <> 0 THEN sw/abs(sl) ELSE 'infinity'::DOUBLE END AS profit_factor, maxw AS max_win, minl AS max_loss,
  sk AS skewness, ad AS avg_duration, aid AS avg_intra_drawdown, mid AS max_intra_drawdown
FROM (SELECT {keys}, count(*) AS n, count(*) FILTER ({ret} > 0)/count(*)::DOUBLE AS wr, coalesce(avg({ret}) FILTER ({ret} > 0), 0) AS aw,
  coalesce(avg({ret}) FILTER ({ret} < 0), 0) AS al, sum({ret}) AS sr, max({ret}) AS mx, quantile_cont({ret}, 0.5::DOUBLE) AS med,
  coalesce(sum({ret}) FILTER ({ret} > 0), 0) AS sw, coalesce(sum({ret}) FILTER ({ret} < 0), 0) AS sl,
  coalesce(max({ret}) FILTER ({ret} > 0), 0) AS maxw, coalesce(min({ret}) FILTER ({ret} < 0), 0) AS minl,
  CASE WHEN count(*) >= 3 THEN coalesce(skewness({ret}), 0) END AS sk, avg(duration) AS ad, avg({dd}) AS aid, min({dd}) AS mid
  FROM {source} GROUP BY {keys}) GROUP BY ALL""".replace("count(*) AS n_trades, wr", "any_value(n) AS n_trades, wr")
