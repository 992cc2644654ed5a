"""Bar scans, normalisation, date filters, latest bars, tick resampling, source priority."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barledger.schema import (
    PRICE_COLUMNS,
    nan_to_null,
    require_columns,
)

# Accepted names of the time column, first match wins (fixed values).
TIME_COLUMN_NAMES = ("date", "timestamp", "datetime", "time")
# Symbol and extension of a bar file, or of the folder Spark wrote it as.
_FILE_NAME = r"([^/]+)\.(parquet|csv)(?:/[^/]*)?$"


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim and lower-case headers, find the time column, keep the five price columns; a bar without a time fails."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    time_name = next((c for c in TIME_COLUMN_NAMES if c in df.columns), None)
    if time_name is None:
        raise ValueError(f"no time column among {df.columns}")
    require_columns(df, *PRICE_COLUMNS)
    no_time = F.raise_error(F.lit(f"a bar without a time in column {time_name}")).cast("timestamp_ntz")
    kept = [F.coalesce(F.col(time_name).cast("timestamp_ntz"), no_time).alias("ts")]
    if "symbol" in df.columns:
        kept.insert(0, F.col("symbol"))
    kept += [F.col(c).cast("double").alias(c) for c in PRICE_COLUMNS]
    return nan_to_null(df.select(*kept))


def read_bars(
    spark: SparkSession, folder: str, symbols: Sequence[str], start=None, end=None
) -> DataFrame:
    """One file per symbol under ``folder``; ``SYM.parquet`` wins over ``SYM.csv``.

    Files may differ in names, order and number of columns: only their headers are read first, then
    every layout is scanned and normalised by itself.
    """
    found = _files_for(spark, folder, symbols)
    parquet = [s for s in symbols if f"{s}.parquet" in found]
    csv = [s for s in symbols if s not in parquet and f"{s}.csv" in found]
    missing = sorted(set(symbols) - set(parquet) - set(csv))
    if missing:
        raise FileNotFoundError(f"no bar file for {missing} in {folder}")
    readers = {
        "parquet": lambda paths: spark.read.parquet(*paths),
        "csv": lambda paths: spark.read.option("header", True).csv(paths),
    }
    name = F.regexp_extract(F.input_file_name(), _FILE_NAME, 1)
    out = None
    for kind, wanted in (("parquet", parquet), ("csv", csv)):
        layouts: dict[tuple, list[str]] = {}
        for symbol in wanted:
            path = f"{folder}/{symbol}.{kind}"
            layouts.setdefault(tuple(readers[kind]([path]).dtypes), []).append(path)
        for paths in layouts.values():
            bars = normalise_headers(readers[kind](paths).withColumn("symbol", F.url_decode(name)))
            out = bars if out is None else out.unionByName(bars)
    return between(out, start, end)


def _files_for(spark: SparkSession, folder: str, symbols: Sequence[str]) -> set[str]:
    """Which of the wanted bar files exist; lists paths only, contents are pruned away."""
    name = F.url_decode(F.regexp_extract("path", _FILE_NAME, 1))
    paths = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(name.alias("symbol"), F.regexp_extract("path", _FILE_NAME, 2).alias("ext"))
        .where(F.col("symbol").isin(list(symbols)))
        .distinct()
    )
    return {f"{r.symbol}.{r.ext}" for r in paths.collect()}


def between(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive date range; both bounds reach the Parquet scan as pushed filters."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return bars


def trim_to_end(bars: DataFrame, end: date | datetime) -> DataFrame:
    """A plain date covers its whole day; a datetime is an exact cut-off."""
    if isinstance(end, datetime):
        return bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    next_day = datetime(end.year, end.month, end.day) + timedelta(days=1)
    return bars.where(F.col("ts") < F.lit(next_day).cast("timestamp_ntz"))


def latest_bars(bars: DataFrame, n: int = 1, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last ``n`` bars of every symbol (group-limited before the shuffle by Catalyst)."""
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return bars.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")


def bar_slot(ts: Column, timeframe: str) -> Column:
    """Start of the bar that holds ``ts``."""
    unit = {"1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1mo": "month"}.get(timeframe)
    if unit:
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    minutes = {"5m": 5, "15m": 15, "30m": 30, "4h": 240}[timeframe]
    return F.window(ts, f"{minutes} minutes")["start"].cast("timestamp_ntz")


def resample(
    ticks: DataFrame,
    symbol: Column,
    ts: Column,
    price: Column,
    sequence: Column,
    timeframe: str,
    keys: dict[str, Column] | None = None,
) -> DataFrame:
    """Ticks to bars. ``sequence`` orders ticks inside a bar and must be unique there.

    One partially aggregated shuffle on (symbol, bar): a hot symbol is spread over its bars, and a
    hot bar arrives as one pre-aggregated row per map task. A numeric ``sequence`` keeps the
    aggregate hash-based.
    """
    keys = keys or {}
    named = ticks.select(
        *[c.alias(n) for n, c in keys.items()],
        symbol.alias("symbol"),
        bar_slot(ts, timeframe).alias("ts"),
        price.alias("price"),
        sequence.alias("seq"),
    )
    return named.groupBy(*keys, "symbol", "ts").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def prefer_sources(frames: Sequence[tuple[int, DataFrame]], key: str = "symbol") -> DataFrame:
    """Per symbol, keep all rows of the highest-priority source that has any."""
    tagged = None
    for priority, frame in frames:
        frame = frame.withColumn("priority", F.lit(priority))
        tagged = frame if tagged is None else tagged.unionByName(frame, allowMissingColumns=True)
    best = tagged.groupBy(key).agg(F.max("priority").alias("priority"))
    return tagged.join(best, [key, "priority"])


def search_symbols(bars: DataFrame, text: str) -> DataFrame:
    return bars.select("symbol").distinct().where(
        F.contains(F.upper("symbol"), F.upper(F.lit(text)))
    )


def index_members(constituents: DataFrame, index: str) -> DataFrame:
    return constituents.where(F.col("index_name") == index).select("symbol")
