"""Column contracts shared by every module, plus NaN handling at the scan boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
)

# Bar widths in seconds; week and month use their shortest calendar length.
TIMEFRAME_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "4h": 14400,
    "1d": 86400,
    "1w": 7 * 86400,
    "1mo": 28 * 86400,
}

#: Width of prices and rates that are looked up by calendar date.
DAILY = "1d"

FUNDAMENTAL_COLUMNS = (
    "market_cap", "enterprise_value", "pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda", "roe", "roa",
    "debt_to_equity", "current_ratio", "gross_margin", "operating_margin", "net_margin",
    "revenue_growth_yoy", "earnings_growth_yoy",
)

ROLES = ("custom", "managed_benchmark", "protected", "holding")

# Fill method -> (bar return column, equity column).
FILL_METHODS = {
    "mtc": ("return_mark_to_close", "strategy_equity_mark_to_close"),
    "conservative": ("return_conservative", "strategy_equity_conservative"),
    "net": ("return_net", "strategy_equity_net"),
}

PERIODS_PER_YEAR = 252


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def finite(col: Column) -> Column:
    """NaN and infinities become NULL, so comparisons behave as they do on missing data."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply once, right after a scan: Spark orders NaN above every number."""
    fixes = {
        f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df
