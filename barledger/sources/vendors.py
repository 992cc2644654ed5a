"""Normalisers for vendor payloads landed as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from barledger.schema import FUNDAMENTAL_COLUMNS, PRICE_COLUMNS, nan_to_null

# Short column names of one payload and the fields they carry (fixed values).
SHORT_NAMES = {"t": "ts", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap"}

# Vendor field of each fundamental figure (fixed values).
FUNDAMENTAL_FIELDS = {
    "market_cap": "marketCap", "enterprise_value": "enterpriseValue", "pe_ratio": "trailingPE", "pb_ratio": "priceToBook",
    "ps_ratio": "priceToSalesTrailing12Months", "ev_ebitda": "enterpriseToEbitda", "roe": "returnOnEquity", "roa": "returnOnAssets",
    "gross_margin": "grossMargins", "operating_margin": "operatingMargins", "net_margin": "profitMargins",
    "debt_to_equity": "debtToEquity", "current_ratio": "currentRatio", "revenue_growth_yoy": "revenueGrowth",
    "earnings_growth_yoy": "earningsGrowth",
}


def wide_bars(raw: DataFrame, symbols: Sequence[str], time_column: str = "Date", separator: str = "|") -> DataFrame:
    """One column per (symbol, field) pair, in either order, to long bars.

    The level that holds tickers is the one that matches the requested symbols; absent symbols are
    skipped and rows without any value dropped. A flat frame belongs to the single symbol asked for.
    """
    wanted, fields = set(symbols), set(PRICE_COLUMNS)
    plan: dict[str, dict[str, str]] = {}
    for name in raw.columns:
        parts = name.split(separator)
        if len(parts) == 2:
            level = next((i for i, p in enumerate(parts) if p in wanted), None)
            if level is not None and parts[1 - level].lower() in fields:
                plan.setdefault(parts[level], {})[parts[1 - level].lower()] = name
        elif len(symbols) == 1 and name.lower() in fields:
            plan.setdefault(symbols[0], {})[name.lower()] = name
    bars = F.array(*[
        F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{cols[f]}`").cast("double").alias(f) for f in PRICE_COLUMNS])
        for s, cols in plan.items() if len(cols) == len(PRICE_COLUMNS)
    ])
    long = nan_to_null(raw.select(F.col(time_column).cast("timestamp_ntz").alias("ts"), F.inline(bars)))
    return long.dropna("all", subset=list(PRICE_COLUMNS)).select("symbol", "ts", *PRICE_COLUMNS)


def short_named_bars(raw: DataFrame) -> DataFrame:
    named = raw.withColumnsRenamed({k: v for k, v in SHORT_NAMES.items() if k in raw.columns})
    return nan_to_null(named.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def aggregate_bars(raw: DataFrame) -> DataFrame:
    """Rows ``symbol, aggs`` with an array of aggregates stamped in epoch milliseconds (UTC)."""
    one = raw.select("symbol", F.explode("aggs").alias("a"))
    return nan_to_null(one.select(
        "symbol", F.to_utc_timestamp(F.timestamp_millis("a.timestamp"), "UTC").cast("timestamp_ntz").alias("ts"),
        *[F.col(f"a.{c}").cast("double").alias(c) for c in (*PRICE_COLUMNS, "vwap")],
    ))


def fundamentals(raw: DataFrame, as_of, fields: Mapping[str, str] = FUNDAMENTAL_FIELDS) -> DataFrame:
    """Snapshot per symbol from a row of vendor fields; the rest goes to the ``extra`` map."""
    known = set(fields.values()) | {"symbol"}
    rest = [c for c in raw.columns if c not in known]
    pairs = [x for c in rest for x in (F.lit(c), F.expr(f"try_cast(`{c}` AS double)"))]
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if rest else F.lit(None)

    def figure(name: str):
        source = fields.get(name)
        return (F.col(f"`{source}`") if source in raw.columns else F.lit(None)).cast("double").alias(name)

    return raw.select(
        "symbol", F.lit(as_of).cast("date").alias("as_of"), *[figure(n) for n in FUNDAMENTAL_COLUMNS],
        extra.cast("map<string,double>").alias("extra"),
    )
