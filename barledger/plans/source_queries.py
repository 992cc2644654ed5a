"""Queries on sheet, JSON and vendor sources. The payloads are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barledger.functions import listings
from barledger.operators import explorer
from barledger.plans import tables as t
from barledger.plans.bar_queries import OHLCV
from barledger.plans.book_queries import panel_and_values, ticker_returns
from barledger.operators import returns as rt
from barledger.plans.oracle_base import define
from barledger.plans.registry import query
from barledger.session import settle
from barledger.sources import book_json, sheets, sinks, vendors

PRIORITIES = [row[0] for row in t.UNIVERSE]


def wide_payload(spark, sf):
    """Weekly bars as one row per date with a column per (field, symbol)."""
    bars = t.bars_week(spark, sf)
    fields = ["open", "high", "low", "close", "volume"]
    cols = [
        F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{f.capitalize()}|{s}") for s in PRIORITIES for f in fields
    ]
    return bars.groupBy(F.col("ts").alias("Date")).agg(*cols)


@query("vendor_wide_bars", "symbol ts", nums=OHLCV, sql="SELECT * FROM bars_week")
def vendor_wide_bars(spark, sf):
    return vendors.wide_bars(wide_payload(spark, sf), [*PRIORITIES, "ABSENT"])


@query("vendor_short_names", "symbol ts", nums=OHLCV + " vwap", sql="SELECT *, (high + low + close)/3 AS vwap FROM bars_week")
def vendor_short_names(spark, sf):
    b = t.bars_week(spark, sf)
    vwap = (F.col("high") + F.col("low") + F.col("close")) / 3
    raw = b.select("symbol", F.col("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                   F.col("close").alias("c"), F.col("volume").alias("v"), vwap.alias("vw"))
    return vendors.short_named_bars(raw)


@query("vendor_epoch_aggregates", "symbol ts", nums=OHLCV, sql="SELECT * FROM bars_hour")
def vendor_epoch_aggregates(spark, sf):
    """One payload per symbol and day, stamped in epoch milliseconds."""
    b = t.bars_hour(spark, sf)
    one = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "open", "high", "low", "close", "volume", F.col("close").alias("vwap"))
    raw = b.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.collect_list(one).alias("aggs"))
    return vendors.aggregate_bars(raw)


@query("fundamentals", "symbol as_of", "n_extra", "market_cap pe_ratio", digits=4,
       sql="SELECT s_suppkey::VARCHAR AS symbol, DATE '2001-01-01' AS as_of, s_acctbal*100 AS market_cap, s_acctbal/10 AS pe_ratio, 1 AS n_extra FROM supplier")
def fundamentals(spark, sf):
    raw = t.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_acctbal") * 100).alias("marketCap"),
        (F.col("s_acctbal") / 10).alias("trailingPE"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("label"),
    )
    return vendors.fundamentals(raw, "2001-01-01").withColumn("n_extra", F.size("extra"))


VALUE_DATES = ("2000-06-30", "2000-12-29", "2001-06-29")
define("snap_values", """SELECT name, snap_date, CASE WHEN name IN ('AMERICA','ASIA') THEN 'USD' ELSE 'SGD' END AS currency, v AS base_value,
 v*CASE WHEN name IN ('AMERICA','ASIA') THEN 1.3::DOUBLE ELSE 1 END AS sgd_value FROM (
 SELECT r_name AS name, d AS snap_date, sum(o_totalprice)/100 AS v FROM region_orders, (VALUES (DATE '2000-06-30'), (DATE '2000-12-29'), (DATE '2001-06-29')) v(d)
 WHERE o_orderdate <= d::TIMESTAMP AND NOT (r_name = 'AFRICA' AND d = DATE '2000-06-30') GROUP BY 1, 2)""")


def value_sheet(spark, sf):
    """Wide sheet with one SGD and one base column per snapshot date; the first value of AFRICA is missing."""
    usd = F.col("r_name").isin("AMERICA", "ASIA")
    cols = []
    for d in VALUE_DATES:
        y, m, day = d.split("-")
        total = F.sum(F.when(F.col("o_orderdate") <= F.lit(d).cast("timestamp_ntz"), F.col("o_totalprice"))) / 100
        if d == VALUE_DATES[0]:
            total = F.when(F.col("r_name") != "AFRICA", total)
        cols.append(total.cast("string").alias(f"{m}/{day}/{y} (Base)"))
        cols.append((total * F.when(usd, 1.3).otherwise(1.0)).cast("string").alias(f"{m}/{day}/{y} (SGD)"))
    rows = t.orders_by_region(spark, sf).groupBy("r_name").agg(*cols)
    return rows.withColumn("Currency", F.when(usd, "usd").otherwise("sgd")).withColumnRenamed("r_name", "Portfolio")


def snapshots(spark, sf):
    return sheets.portfolio_values(value_sheet(spark, sf), "Portfolio", "Currency")


@query("sheet_portfolio_values", "name snap_date currency", nums="base_value sgd_value", digits=1, sql="SELECT * FROM snap_values")
def sheet_portfolio_values(spark, sf):
    return snapshots(spark, sf)


@query("nearest_snapshot", "name snap_date", nums="base_value", digits=1,
       sql="SELECT * FROM snap_values WHERE snap_date = DATE '2000-12-29'")
def nearest_snapshot(spark, sf):
    return sheets.nearest_snapshot(settle(snapshots(spark, sf)), "2001-01-20")


@query("latest_snapshot", "name snap_date", nums="base_value", digits=1, sql="SELECT * FROM snap_values WHERE snap_date = DATE '2000-12-29'")
def latest_snapshot(spark, sf):
    return sheets.latest_snapshot(settle(snapshots(spark, sf)), "2001-06-01")


define("sheet_targets", """SELECT name, eff_date, ticker, weight*CASE WHEN name = 'EUROPE' AND eff_date = DATE '2000-07-01' THEN 1.1::DOUBLE ELSE 1 END AS weight FROM (
 SELECT r_name AS name, DATE '2000-07-01' AS eff_date, o_orderpriority AS ticker, sum(o_totalprice)/sum(sum(o_totalprice)) OVER (PARTITION BY r_name) AS weight FROM region_orders WHERE year(o_orderdate) = 1999 GROUP BY r_name, o_orderpriority
 UNION ALL SELECT r_name, DATE '2000-01-01', o_orderpriority, sum(o_totalprice)/sum(sum(o_totalprice)) OVER (PARTITION BY r_name) FROM region_orders WHERE year(o_orderdate) = 1998 GROUP BY r_name, o_orderpriority)""")


def target_sheet(spark, sf):
    """Wide target sheet; one snapshot of EUROPE does not sum to one, the weights of one ticker come in two rows."""
    def share(year: int):
        return F.sum(F.when(F.year("o_orderdate") == year, F.col("o_totalprice")))

    sums = t.orders_by_region(spark, sf).groupBy("r_name", "o_orderpriority").agg(share(1998).alias("a"), share(1999).alias("b"))
    totals = sums.groupBy("r_name").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    off = F.when(F.col("r_name") == "EUROPE", 1.1).otherwise(1.0)
    half = sums.join(totals, "r_name").withColumn("_part", F.explode(F.array(F.lit(0.25), F.lit(0.75))))
    return half.select(
        F.col("r_name").alias("Port"), F.col("o_orderpriority").alias("Ticker"),
        (F.col("a") / F.col("ta") * F.col("_part")).cast("string").alias("Target % 2000-01-01"),
        (F.col("b") / F.col("tb") * F.col("_part") * off).cast("string").alias("Target % 2000-07-01"),
    )


@query("sheet_target_weights", "name eff_date ticker", nums="weight",
       sql="SELECT * FROM sheet_targets WHERE NOT (name = 'EUROPE' AND eff_date = DATE '2000-07-01')")
def sheet_target_weights(spark, sf):
    return sheets.target_weights(target_sheet(spark, sf), t.universe(spark, sf), "Port", "Ticker")


@query("sheet_target_aliases", "name eff_date ticker", nums="weight",
       sql="SELECT * FROM sheet_targets WHERE NOT (name = 'EUROPE' AND eff_date = DATE '2000-07-01')")
def sheet_target_aliases(spark, sf):
    """Portfolios under other names, and cash lines without a ticker that are known by their currency column."""
    low, asia = F.col("Ticker") == "5-LOW", F.col("Port") == "ASIA"
    sheet = target_sheet(spark, sf).withColumns({
        "Port": F.when(asia, " Asia fund ").otherwise(F.col("Port")),
        "Cash": F.when(low, F.lit("sgd cash")), "Ticker": F.when(~low, F.col("Ticker")).otherwise(F.lit("  ")),
    })
    return sheets.target_weights(sheet, t.universe(spark, sf), "Port", "Ticker", "Cash", {"Asia fund": "ASIA"}, {"SGD CASH": "5-LOW"})


@query("sheet_value_aliases", "name snap_date currency", nums="base_value sgd_value", digits=1, sql="SELECT * FROM snap_values")
def sheet_value_aliases(spark, sf):
    """The value sheet with one portfolio under its former name."""
    sheet = value_sheet(spark, sf).withColumn("Portfolio", F.when(F.col("Portfolio") == "EUROPE", "EMEA").otherwise(F.col("Portfolio")))
    return sheets.portfolio_values(sheet, "Portfolio", "Currency", {"EMEA": "EUROPE"})


@query("sheet_deposits", "name date currency notes", nums="amount fx_to_base", digits=2,
       sql="SELECT name, date, 'SGD' AS currency, '' AS notes, amount, NULL::DOUBLE AS fx_to_base FROM deposit WHERE date > DATE '2000-10-03'")
def sheet_deposits(spark, sf):
    d = t.deposit(spark, sf)
    sheet = d.select(F.col("date").cast("string").alias("date"), F.col("name").alias("portfolio"), F.lit("").alias("currency"),
                     F.col("amount").cast("string").alias("amount"), F.lit(None).cast("string").alias("notes"), F.lit("n/a").alias("fx"))
    return sheets.deposits(sheet, since="2000-10-03")


def assembled(spark, sf):
    targets = settle(sheets.target_weights(target_sheet(spark, sf), t.universe(spark, sf), "Port", "Ticker"))
    names = t.table(spark, sf, "region").select(F.col("r_name").alias("name"))
    roles = names.where("name = 'EUROPE'").withColumn("roles", F.array(F.lit("holding"), F.lit("managed_benchmark")))
    fees = names.where("name = 'ASIA'").withColumn("fee_annual", F.lit(0.008))
    return sheets.assemble_book(settle(snapshots(spark, sf)), targets, t.universe(spark, sf), roles, fees, "2000-12-29")


@query("assembled_portfolios", "name statement_date currency role_text", nums="total_value fee_annual statement_fx", digits=1,
       sql="""SELECT name, snap_date AS statement_date, currency, CASE name WHEN 'EUROPE' THEN 'holding,managed_benchmark' ELSE 'holding' END AS role_text, base_value AS total_value,
 CASE name WHEN 'ASIA' THEN 0.008::DOUBLE ELSE 0 END AS fee_annual, CASE WHEN currency = 'USD' THEN sgd_value/base_value END AS statement_fx FROM snap_values WHERE snap_date = DATE '2000-12-29' AND name <> 'EUROPE'""")
def assembled_portfolios(spark, sf):
    return assembled(spark, sf)[0].withColumn("role_text", F.array_join("roles", ","))


@query("assembled_holdings", "name ticker", nums="weight",
       sql="SELECT name, ticker, weight FROM sheet_targets WHERE eff_date = DATE '2000-07-01' AND name <> 'EUROPE'")
def assembled_holdings(spark, sf):
    return assembled(spark, sf)[1]


@query("assembly_rejects", "name ticker reason", sql="SELECT 'EUROPE' AS name, NULL::VARCHAR AS ticker, 'no composition' AS reason")
def assembly_rejects(spark, sf):
    return assembled(spark, sf)[2]


def book_document(spark, sf):
    """The holdings as one JSON-shaped document per portfolio, with legacy ids for one ticker."""
    h = t.holding(spark, sf)
    legacy = F.col("ticker") == "2-HIGH"
    item = F.struct(
        F.when(~legacy, F.col("ticker")).alias("ticker"), F.when(legacy, "old2").alias("legacy_id"), "weight", "value"
    )
    docs = h.groupBy("name").agg(F.collect_list(item).alias("holdings"), F.sum("value").alias("total_value"))
    text = docs.select(F.to_json(F.struct(
        F.lit(t.STATEMENT_DATE).alias("statement_date"), F.lit("SGD").alias("currency"),
        F.array(F.struct("name", "total_value", "holdings")).alias("portfolios"),
    )).alias("j"))
    return text.select(F.from_json("j", book_json.BOOK_SCHEMA).alias("d")).select("d.*")


@query("book_json_holdings", "name ticker", nums="weight", sql="SELECT name, ticker, weight FROM holding")
def book_json_holdings(spark, sf):
    return book_json.parse_book(book_document(spark, sf), id_map={"old2": "2-HIGH"})[1]


@query("book_json_anonymised", "name", nums="total_value", digits=0,
       sql="SELECT CASE name WHEN 'ASIA' THEN 'Portfolio A' ELSE name END AS name, sum(value)*0.37::DOUBLE AS total_value FROM holding GROUP BY ALL")
def book_json_anonymised(spark, sf):
    p, h = book_json.parse_book(book_document(spark, sf), id_map={"old2": "2-HIGH"})
    return book_json.anonymise(p, h, 0.37, {"ASIA": "Portfolio A"})[0]


@query("run_key", "o_orderpriority run_id",
       sql="""SELECT o_orderpriority, sha256('{"bars":' || count(*) || ',"end":"' || max(o_orderdate)::DATE || '","start":"' || min(o_orderdate)::DATE || '","symbol":"' || o_orderpriority || '"}') AS run_id
 FROM orders GROUP BY o_orderpriority""")
def run_key(spark, sf):
    """Id of the request that would bring the orders of each priority."""
    day = lambda c: c.cast("date").cast("string")
    spans = t.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        day(F.min("o_orderdate")).alias("_from"), day(F.max("o_orderdate")).alias("_to"), F.count("*").alias("_n"))
    key = sinks.request_key(symbol=F.col("o_orderpriority"), start=F.col("_from"), end=F.col("_to"), bars=F.col("_n"))
    return spans.select("o_orderpriority", key.alias("run_id"))


# ------------------------------------------------------------------ listings, explorer, audits

define("codes", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'P' || p_partkey || ' LN' WHEN 1 THEN 'P' || p_partkey || ' SP' WHEN 2 THEN 'P' || p_partkey || ':HK' WHEN 3 THEN 'P' || p_partkey ELSE 'P' || p_partkey || ' ZZ' END AS code,
 p_name || CASE WHEN p_partkey % 2 = 0 THEN ' UCITS' ELSE '' END AS name FROM part""")


def codes(spark, sf):
    k = F.col("p_partkey")
    body = F.concat(F.lit("P"), k.cast("string"))
    code = (
        F.when(k % 5 == 0, F.concat(body, F.lit(" LN"))).when(k % 5 == 1, F.concat(body, F.lit(" SP")))
        .when(k % 5 == 2, F.concat(body, F.lit(":HK"))).when(k % 5 == 3, body).otherwise(F.concat(body, F.lit(" ZZ")))
    )
    name = F.concat("p_name", F.when(k % 2 == 0, " UCITS").otherwise(""))
    return t.table(spark, sf, "part").select("p_partkey", code.alias("code"), name.alias("name"))


@query("fund_listing", "p_partkey code ticker wrapper currency",
       sql="""SELECT *, CASE WHEN ticker LIKE '%.SI' THEN 'SGD' WHEN ticker LIKE '%.HK' THEN 'HKD' ELSE 'USD' END AS currency FROM (SELECT p_partkey, code, CASE WHEN code = 'P5 LN' THEN 'P5X' ELSE CASE p_partkey % 5 WHEN 0 THEN 'P' || p_partkey || '.L' WHEN 1 THEN 'P' || p_partkey || '.SI' WHEN 2 THEN 'P' || p_partkey || '.HK'
 WHEN 3 THEN 'P' || p_partkey || CASE WHEN name LIKE '%UCITS' THEN '.L' ELSE '' END ELSE 'P' || p_partkey END END AS ticker,
 CASE p_partkey % 5 WHEN 0 THEN 'UCITS (LSE)' WHEN 1 THEN 'SG' WHEN 2 THEN 'HK' ELSE '?' END AS wrapper FROM codes)""")
def fund_listing(spark, sf):
    rows = explorer.fund_universe(codes(spark, sf), {"P5 LN": "P5X"})
    return rows.withColumn("currency", listings.listing_currency(F.col("ticker")))


@query("compact_numbers", "o_orderkey plain signed",
       sql="""SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || b AS plain, CASE WHEN v = 0 THEN '0' WHEN v < 0 THEN '-' || b ELSE '+' || b END AS signed FROM (
 SELECT o_orderkey, v, CASE WHEN abs(v) >= 1e9 THEN printf('%.2fB', abs(v)/1e9) WHEN abs(v) >= 1e6 THEN printf('%.2fM', abs(v)/1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', abs(v)/1e3) ELSE printf('%.0f', abs(v)) END AS b
 FROM (SELECT o_orderkey, (o_totalprice*CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -77.77::DOUBLE WHEN 2 THEN 0.00137::DOUBLE ELSE 31234.567::DOUBLE END) AS v FROM orders))""")
def compact_numbers(spark, sf):
    k = F.col("o_orderkey") % 4
    v = F.col("o_totalprice") * F.when(k == 0, 1.0).when(k == 1, -77.77).when(k == 2, 0.00137).otherwise(31234.567)
    return t.table(spark, sf, "orders").select("o_orderkey", listings.compact(v).alias("plain"), listings.compact(v, signed=True).alias("signed"))


_W = {"1Y": 252, "3Y": 756, "5Y": 1260}
_FUND_NUMS = "cum_return_1M cum_return_3M ytd_return " + " ".join(f"sharpe_{w} ann_return_{w} max_dd_{w} vol_{w}" for w in _W)
_CORR = {"1M": (21, 10), "3M": (63, 20), "1Y": (252, 20), "3Y": (756, 20), "5Y": (1260, 20)}
_WINDOW_SQL = " ".join(
    f"""LEFT JOIN (SELECT symbol, pow(product(1 + ret), 252.0::DOUBLE/count(*)) - 1 AS ann_return_{w}, stddev_samp(ret)*sqrt(252) AS vol_{w}, avg(ret)*252/(stddev_samp(ret)*sqrt(252)) AS sharpe_{w}, min(g/k - 1) AS max_dd_{w}
 FROM (SELECT *, max(g) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM fr WHERE nth <= {n})) GROUP BY symbol) USING (symbol)"""
    for w, n in _W.items()
)
define("fr", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth, max(year(ts)) OVER (PARTITION BY symbol) AS ly FROM week_ret WHERE ret IS NOT NULL")


_FUND_SQL = f"""SELECT symbol AS ticker, * FROM (SELECT symbol, count(*) AS n_days, product(CASE WHEN nth <= 21 THEN 1 + ret END) - 1 AS "cum_return_1M", product(CASE WHEN nth <= 63 THEN 1 + ret END) - 1 AS "cum_return_3M",
 product(CASE WHEN year(ts) = ly THEN 1 + ret END) - 1 AS ytd_return FROM fr GROUP BY symbol) {_WINDOW_SQL}"""


@query("fund_metrics", "ticker", "n_days", _FUND_NUMS, sql=_FUND_SQL)
def fund_metrics(spark, sf):
    return explorer.fund_metrics(ticker_returns(spark, sf), timeframe="1w")


@query("fund_metrics_blocked", "ticker", "n_days", _FUND_NUMS, sql=_FUND_SQL)
def fund_metrics_blocked(spark, sf):
    """Slices of seven weeks, so that many of them are passed over."""
    return explorer.fund_metrics(ticker_returns(spark, sf), timeframe="1w", slice_rows=7)


_SUPPLIER_SQL = _FUND_SQL
for _table, _other in (("week_ret", "supp_ret"), ("fr", "supplier_fr")):
    _SUPPLIER_SQL = _SUPPLIER_SQL.replace(f"FROM {_table} ", f"FROM {_other} ")
define("supplier_fr", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth, max(year(ts)) OVER (PARTITION BY symbol) AS ly FROM supp_ret WHERE ret IS NOT NULL")


@query("fund_metrics_suppliers", "ticker", "n_days", _FUND_NUMS, sql=_SUPPLIER_SQL)
def fund_metrics_suppliers(spark, sf):
    """Many tickers with daily bars; their number grows with the tables."""
    from barledger.plans.book_queries import supplier_panel

    daily = settle(supplier_panel(spark, sf).select(F.col("name").alias("ticker"), "ts", "ret"))
    return explorer.fund_metrics(daily, timeframe="1d")


define("fb", "SELECT f.symbol, f.ts, f.ret, b.ret AS book_ret, row_number() OVER (PARTITION BY symbol ORDER BY f.ts DESC) AS nth, max(year(f.ts)) OVER (PARTITION BY symbol) AS ly FROM week_ret f JOIN book_ret b USING (ts) WHERE f.ret IS NOT NULL")


@query("fund_explorer", "ticker asset_class has_data", "n_days corr_n", "ytd_return " + " ".join(f"corr_book_{w}" for w in (*_CORR, "YTD")),
       sql=f"""SELECT u.ticker, asset_class, n_days IS NOT NULL AS has_data, coalesce(n_days, 0) AS n_days, coalesce(corr_n, 0) AS corr_n, ytd_return, {', '.join(f'"corr_book_{w}"' for w in (*_CORR, 'YTD'))} FROM (SELECT ticker, asset_class FROM universe UNION ALL SELECT 'NO DATA', 'Bond') u
 LEFT JOIN (SELECT symbol AS ticker, count(*) AS n_days, product(CASE WHEN year(ts) = ly THEN 1 + ret END) - 1 AS ytd_return FROM fr GROUP BY symbol) USING (ticker)
 LEFT JOIN (SELECT symbol AS ticker, count(*) AS corr_n, {', '.join(f'CASE WHEN count(*) FILTER (nth <= {n}) >= {m} THEN corr(ret, book_ret) FILTER (nth <= {n}) END AS "corr_book_{w}"' for w, (n, m) in _CORR.items())},
 CASE WHEN count(*) FILTER (year(ts) = ly) >= 20 THEN corr(ret, book_ret) FILTER (year(ts) = ly) END AS "corr_book_YTD" FROM fb GROUP BY symbol) USING (ticker)""")
def fund_explorer(spark, sf):
    rets = settle(ticker_returns(spark, sf))
    book = rt.book_returns(*panel_and_values(spark, sf)).withColumnRenamed("ret", "book_ret")
    known = t.universe(spark, sf).select("ticker", "asset_class")
    missing = spark.createDataFrame([("NO DATA", "Bond")], "ticker string, asset_class string")
    return explorer.fund_explorer(known.unionByName(missing), rets, book, timeframe="1w")


@query("universe_audit", "name ticker status",
       sql="SELECT name, ticker, CASE WHEN ticker IN (SELECT ticker FROM universe WHERE region <> 'US') THEN 'verified' ELSE 'new' END AS status FROM holding")
def universe_audit(spark, sf):
    return explorer.universe_audit(t.holding(spark, sf), t.universe(spark, sf).where("region <> 'US'"))


@query("composition_drift", "name ticker status", nums="statement_weight target_weight drift",
       sql="""SELECT *, target_weight - statement_weight AS drift FROM (SELECT name, ticker, h.weight AS statement_weight, t.weight AS target_weight,
 CASE WHEN t.weight IS NULL THEN 'only in statement' WHEN h.weight IS NULL THEN 'only in target' WHEN abs(t.weight - h.weight) > 0.005::DOUBLE THEN 'drift' END AS status
 FROM (SELECT * FROM holding WHERE NOT (name = 'ASIA' AND ticker = '5-LOW')) h FULL JOIN (SELECT * FROM target_weight WHERE ticker <> '2-HIGH') t USING (name, ticker)) WHERE status IS NOT NULL""")
def composition_drift(spark, sf):
    held = t.holding(spark, sf).where("NOT (name = 'ASIA' AND ticker = '5-LOW')")
    return explorer.composition_drift(held, t.target_weight(spark, sf).where("ticker <> '2-HIGH'"), 0.005)
