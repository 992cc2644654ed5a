"""Sheets exported as CSV: wide date columns become long tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barledger.schema import require_columns

# Header shapes (fixed values).
VALUE_HEADER = r"^\s*(\d{2}/\d{2}/\d{4})\s*\((SGD|Base)\)\s*$"
TARGET_HEADER = r"^\s*Target\s*%\s*(\d{4}-\d{2}-\d{2})\s*$"
TARGET_SUM_TOLERANCE = 0.02
DEFAULT_CURRENCY = "SGD"


def alias(col: Column, names: Mapping[str, str] | None) -> Column:
    """Replace known aliases, keep everything else."""
    if not names:
        return col
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), col)


def _text(name: str) -> Column:
    value = F.trim(F.col(f"`{name}`").cast("string"))
    return F.when(value != "", value)


def portfolio_values(
    sheet: DataFrame, name_column: str, currency_column: str, aliases: Mapping[str, str] | None = None
) -> DataFrame:
    """Snapshots (``name, snap_date, currency, base_value, sgd_value``); a date needs both tags."""
    require_columns(sheet, name_column, currency_column)
    dated = [c for c in sheet.columns if re.match(VALUE_HEADER, c, re.IGNORECASE)]
    rows = sheet.select(
        alias(_text(name_column), aliases).alias("name"), F.upper(_text(currency_column)).alias("currency"),
        *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in dated],
    ).where("name IS NOT NULL AND currency IS NOT NULL")
    long = rows.unpivot(["name", "currency"], dated, "header", "value")
    pattern = f"(?i){VALUE_HEADER}"
    long = long.select(
        "name", "currency", "value",
        F.to_date(F.regexp_extract("header", pattern, 1), "MM/dd/yyyy").alias("snap_date"),
        F.upper(F.regexp_extract("header", pattern, 2)).alias("tag"),
    )
    both = long.groupBy("name", "currency", "snap_date").agg(
        F.max(F.when(F.col("tag") == "BASE", F.col("value"))).alias("base_value"),
        F.max(F.when(F.col("tag") == "SGD", F.col("value"))).alias("sgd_value"),
    )
    return both.where("base_value IS NOT NULL AND sgd_value IS NOT NULL")


def target_weights(
    sheet: DataFrame, universe: DataFrame, name_column: str, ticker_column: str, cash_column: str | None = None,
    aliases: Mapping[str, str] | None = None, cash_aliases: Mapping[str, str] | None = None,
    tolerance: float = TARGET_SUM_TOLERANCE,
) -> DataFrame:
    """Target snapshots (``name, eff_date, ticker, weight``); one that does not sum to one is dropped."""
    dated = [c for c in sheet.columns if re.match(TARGET_HEADER, c, re.IGNORECASE)]
    ticker = _text(ticker_column)
    if cash_column is not None and cash_aliases:
        pairs = [F.lit(x) for kv in cash_aliases.items() for x in kv]
        ticker = F.coalesce(ticker, F.element_at(F.create_map(*pairs), F.upper(_text(cash_column))))
    rows = sheet.select(
        alias(_text(name_column), aliases).alias("name"), ticker.alias("ticker"),
        *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in dated],
    ).where("name IS NOT NULL AND ticker IS NOT NULL")
    long = rows.unpivot(["name", "ticker"], dated, "header", "weight").where("weight IS NOT NULL")
    day = F.to_date(F.regexp_extract("header", f"(?i){TARGET_HEADER}", 1))
    known = long.withColumn("eff_date", day).join(universe.select("ticker"), "ticker", "left_semi")
    summed = known.groupBy("name", "eff_date", "ticker").agg(F.sum("weight").alias("weight"))
    good = summed.groupBy("name", "eff_date").agg(F.sum("weight").alias("_sum")).where(F.abs(F.col("_sum") - 1) <= tolerance)
    return summed.join(good.select("name", "eff_date"), ["name", "eff_date"], "left_semi")


def deposits(
    sheet: DataFrame, columns: Sequence[str] = ("date", "portfolio", "currency", "amount", "notes", "fx"),
    since=None, aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Deposit log; rows without date, portfolio or amount drop out, ``since`` itself is excluded."""
    day, name, currency, amount, notes, fx = columns
    out = sheet.select(
        alias(_text(name), aliases).alias("name"),
        F.expr(f"try_cast(`{day}` AS date)").alias("date"),
        F.coalesce(F.upper(_text(currency)), F.lit(DEFAULT_CURRENCY)).alias("currency"),
        F.expr(f"try_cast(`{amount}` AS double)").alias("amount"),
        F.coalesce(_text(notes), F.lit("")).alias("notes"),
        F.expr(f"try_cast(`{fx}` AS double)").alias("fx_to_base"),
    ).where("name IS NOT NULL AND date IS NOT NULL AND amount IS NOT NULL")
    return out if since is None else out.where(F.col("date") > F.lit(since).cast("date"))


def nearest_snapshot(snapshots: DataFrame, at) -> DataFrame:
    """Rows of the snapshot date closest to ``at``; of two equally close ones the earlier."""
    target = F.lit(at).cast("date")
    distance = F.struct(F.abs(F.date_diff("snap_date", target)).alias("gap"), F.col("snap_date").alias("day"))
    chosen = snapshots.select("snap_date").distinct().agg(F.min(distance).alias("_d")).select(F.col("_d.day").alias("snap_date"))
    return snapshots.join(chosen, "snap_date")


def latest_snapshot(snapshots: DataFrame, until) -> DataFrame:
    """Rows of the last snapshot date at or before ``until``."""
    past = snapshots.where(F.col("snap_date") <= F.lit(until).cast("date"))
    return past.join(past.agg(F.max("snap_date").alias("snap_date")), "snap_date")


def assemble_book(
    values: DataFrame, targets: DataFrame, universe: DataFrame, roles: DataFrame, fees: DataFrame, as_of, book_id: str = "current",
    tolerance: float = 1e-4,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(portfolio, holding, rejects) at ``as_of``.

    Values of exactly that date meet the latest target snapshot at or before it, chosen once for the
    whole book. Unknown tickers are dropped; portfolios without composition or with weights that do
    not sum to one are rejected with a reason. Default role: ``holding``.
    """
    day = F.lit(as_of).cast("date")
    at = values.where(F.col("snap_date") == day)
    past = targets.where(F.col("eff_date") <= day)
    chosen = past.agg(F.max("eff_date").alias("eff_date"))
    composition = past.where("weight > 0").join(chosen, "eff_date").select("name", "ticker", "weight")
    known = composition.join(universe.select("ticker"), "ticker", "left_semi")
    sums = known.groupBy("name").agg(F.sum("weight").alias("_sum"))
    state = at.join(sums, "name", "left").withColumn(
        "reason",
        F.when(F.col("_sum").isNull(), "no composition").when(F.abs(F.col("_sum") - 1) > tolerance, "weights do not sum to one"),
    )
    unknown = composition.join(universe.select("ticker"), "ticker", "left_anti").join(at.select("name"), "name", "left_semi")
    rejects = state.where("reason IS NOT NULL").select("name", F.lit(None).cast("string").alias("ticker"), "reason").unionByName(
        unknown.select("name", "ticker", F.lit("unknown ticker").alias("reason"))
    )
    good = state.where("reason IS NULL")
    usd = (F.col("currency") == "USD") & (F.col("base_value") != 0)
    portfolio = good.join(roles, "name", "left").join(fees, "name", "left").select(
        F.lit(book_id).alias("book_id"), "name", day.alias("statement_date"), F.col("base_value").alias("total_value"), "currency",
        F.coalesce("roles", F.array(F.lit("holding"))).alias("roles"), F.coalesce("fee_annual", F.lit(0.0)).alias("fee_annual"),
        F.when(usd, F.col("sgd_value") / F.col("base_value")).alias("statement_fx"),
    )
    holding = known.join(good.select("name", "base_value"), "name").select(
        F.lit(book_id).alias("book_id"), "name", "ticker", "weight", (F.col("weight") * F.col("base_value")).alias("value")
    )
    return portfolio, holding, rejects
