"""Book health checks: one validation query per rule, each at most a few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barledger.operators.book import with_role
from barledger.operators.projection import PORTFOLIO

TARGET_SUM_TOLERANCE = 0.001
VALUE_TOLERANCE = 0.01
STALE_DAYS = 3
SHOWN = 5
LISTED = 100


def _finding(rule: str, level: str, rows: DataFrame, item: Column) -> DataFrame:
    """Collapse offending rows into one finding that counts all and names the first ``LISTED``; no row, no finding."""
    items = rows.select(item.alias("_i"))
    first = items.distinct().orderBy("_i").limit(LISTED).agg(F.array_sort(F.collect_list("_i")).alias("_items"))
    listed = items.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(first))  # two single rows
    return listed.where("n > 0").select(
        F.lit(rule).alias("rule"), F.lit(level).alias("level"), "n", F.array_join("_items", ", ").alias("items")
    )


def top_deposits(deposits: DataFrame, n: int = SHOWN) -> DataFrame:
    """Largest deposit totals by absolute amount."""
    sums = deposits.groupBy("name").agg(F.sum("amount").alias("amount"))
    return sums.orderBy(F.abs("amount").desc(), "name").limit(n)


def book_health(
    portfolio: DataFrame, holding: DataFrame, universe: DataFrame, roles: DataFrame, observed: DataFrame,
    deposits: DataFrame, targets: DataFrame, fx: DataFrame, end: Column,
) -> DataFrame:
    """Findings (``rule, level, n, items``); a single ``ok`` row if there are none.

    Offenders are counted in full; the report names the first ones in order.
    """
    end_day = end.cast("date")
    held = with_role(portfolio)
    past = observed.where(F.col("snap_date") <= end_day)
    opening = past.join(past.agg(F.min("snap_date").alias("snap_date")), "snap_date")
    funded = opening.where("base_value > 0").select("name", "snap_date")
    rules = [
        _finding("untagged role", "warn", portfolio.join(roles, "name", "left_anti"), F.col("name")),
        _finding(
            "unknown ticker", "err",
            holding.join(held.select(*PORTFOLIO), PORTFOLIO, "left_semi").join(universe, "ticker", "left_anti"),
            F.concat_ws("/", "name", "ticker"),
        ),
        _finding(
            "no first value", "warn",
            held.join(funded, "name", "left_anti").join(deposits, "name", "left_anti"), F.col("name"),
        ),
        _finding("no target", "warn", held.join(targets, "name", "left_anti"), F.col("name")),
        _finding(
            "target sum", "warn",
            targets.groupBy("name", "eff_date").agg(F.sum("weight").alias("_s")).where(F.abs(F.col("_s") - 1) > TARGET_SUM_TOLERANCE),
            F.concat_ws(" ", "name", F.col("eff_date").cast("string"), F.format_string("%.4f", "_s")),
        ),
        _deposit_note(held, funded, deposits),
        _finding(
            "base differs", "err",
            observed.where((F.col("currency") == "SGD") & (F.abs(F.col("base_value") - F.col("sgd_value")) > VALUE_TOLERANCE)),
            F.concat_ws(" ", "name", F.col("snap_date").cast("string")),
        ),
        _finding(
            "stale rate", "warn",
            fx.where("rate IS NOT NULL").agg(F.max("ts").cast("date").alias("_last")).where(F.date_diff(end_day, F.col("_last")) > STALE_DAYS),
            F.col("_last").cast("string"),
        ),
    ]
    found = reduce(DataFrame.unionByName, rules)
    passed = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("all checks").alias("rule"), F.lit("ok").alias("level"), "n", F.lit("").alias("items")
    )
    return found.unionByName(passed)


def _deposit_note(held: DataFrame, funded: DataFrame, deposits: DataFrame) -> DataFrame:
    """Deposits into portfolios that already had a value; the five largest are named."""
    later = deposits.join(held.select("name"), "name", "left_semi").join(funded, "name").where(F.col("date") > F.col("snap_date"))
    sums = later.groupBy("name").agg(F.sum("amount").alias("amount"))
    shown = top_deposits(later).agg(F.array_sort(F.collect_list("name")).alias("_s"))
    counted = sums.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return counted.crossJoin(F.broadcast(shown)).select(  # two single rows
        F.lit("deposits").alias("rule"), F.lit("ok").alias("level"), "n", F.array_join("_s", ", ").alias("items")
    )
