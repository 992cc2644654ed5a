"""Statement-to-today reconciliation per portfolio and per holding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barledger.operators.asof import as_of, effective_targets
from barledger.operators.book import CASH_PREFIX, is_cash_like, with_role
from barledger.operators.projection import PORTFOLIO, accrual, days_between, piecewise_values
from barledger.schema import DAILY

TOTAL_COLUMNS = ("stmt_base", "today_base", "delta_base")


def last_rate(fx: DataFrame) -> DataFrame:
    """The latest rate as a single row."""
    return fx.agg(F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("ts"))).alias("last_fx"))


def portfolio_reconciliation(
    portfolio: DataFrame, holding: DataFrame, universe: DataFrame, targets: DataFrame,
    prices: DataFrame, fx: DataFrame, end: Column,
) -> DataFrame:
    """Value at the statement and at ``end`` per holding portfolio, native and in base currency."""
    valued = piecewise_values(portfolio, holding, universe, targets, prices, end)
    valued = valued.crossJoin(F.broadcast(last_rate(fx)))  # the rate is one row
    usd = F.upper("currency") == "USD"
    now, then = F.coalesce("last_fx", F.lit(1.0)), F.coalesce("statement_fx", F.lit(1.0))
    out = valued.select(
        *PORTFOLIO, F.upper("currency").alias("currency"), F.col("total_value").alias("stmt_native"),
        F.when(usd, F.col("total_value") * then).otherwise(F.col("total_value")).alias("stmt_base"),
        "today_native",
        F.when(usd, F.col("today_native") * now).otherwise(F.col("today_native")).alias("today_base"),
    )
    return out.withColumns({
        "delta_base": F.col("today_base") - F.col("stmt_base"),
        "return_native": _growth(F.col("today_native"), F.col("stmt_native")),
        "return_base": _growth(F.col("today_base"), F.col("stmt_base")),
    })


def _growth(now: Column, then: Column) -> Column:
    return F.when(then > 0, now / then - 1).otherwise(0.0)


def with_totals(rows: DataFrame) -> DataFrame:
    """Portfolio rows and one total per book in the same aggregation."""
    sums = [F.sum(c).alias(c) for c in TOTAL_COLUMNS]
    both = rows.groupingSets([["book_id", "name"], ["book_id"]], "book_id", "name").agg(
        F.grouping("name").alias("is_total"), *sums
    )
    return both.withColumn("return_base", _growth(F.col("today_base"), F.col("stmt_base")))


def covered_targets(portfolio: DataFrame, holding: DataFrame, targets: DataFrame, at: Column) -> DataFrame:
    """Targets in force at ``at``, without portfolios that hold anything the targets leave out."""
    current = effective_targets(portfolio, targets, at)
    held = holding.select(*PORTFOLIO, "ticker").distinct()
    uncovered = held.join(current.select(*PORTFOLIO, "ticker"), [*PORTFOLIO, "ticker"], "left_anti").select(*PORTFOLIO).distinct()
    return current.join(uncovered, PORTFOLIO, "left_anti")


def holdings_reconciliation(
    portfolio: DataFrame, holding: DataFrame, universe: DataFrame, targets: DataFrame,
    prices: DataFrame, fx: DataFrame, end: Column,
) -> DataFrame:
    """Point-to-point value of every holding, weighted by its target if the targets cover the portfolio."""
    wanted = covered_targets(portfolio, holding, targets, end).select(*PORTFOLIO, "ticker", F.col("weight").alias("_target"))
    facts = with_role(portfolio).drop("weight", "value", "ord", "roles").withColumn("_end", end.cast("date"))
    rows = holding.select(*PORTFOLIO, "ticker", "weight").join(facts, PORTFOLIO).join(wanted, [*PORTFOLIO, "ticker"], "left")
    rows = rows.join(universe.withColumn("_cash_like", is_cash_like()), "ticker", "left")
    rows = as_of(rows, prices, ["ticker"], "statement_date", "close", "stmt_price", timeframe=DAILY)
    rows = as_of(rows, prices, ["ticker"], "_end", "close", "today_price", timeframe=DAILY)
    placeholder = F.startswith("ticker", F.lit(CASH_PREFIX))
    p0, p1 = F.col("stmt_price"), F.col("today_price")
    d0, d1 = F.col("stmt_price_ts").cast("date"), F.col("today_price_ts").cast("date")
    priced = ~placeholder & (p0 > 0) & p1.isNotNull()
    missing = days_between(F.col("_end"), d1)
    stale = priced & F.coalesce("_cash_like", F.lit(False)) & (missing > 0)
    rows = rows.withColumns({
        "weight_basis": F.when(F.col("_target").isNotNull(), "target").otherwise("statement"),
        "weight": F.coalesce("_target", "weight"),
        "accrued_days": F.when(stale, missing).otherwise(0),
        "today_price": F.when(stale, p1 * accrual(p0, p1, days_between(d1, d0), missing)).otherwise(p1),
    })
    rows = rows.withColumns({
        "stmt_value": F.col("weight") * F.col("total_value"),
        "ret": F.when(priced, F.col("today_price") / p0 - 1).otherwise(0.0),
        "label": F.concat_ws(" · ", "asset_class", "region"),
    })
    rows = rows.withColumn("today_value", F.col("stmt_value") * (1 + F.col("ret")))
    rows = rows.crossJoin(F.broadcast(last_rate(fx)))  # the rate is one row
    both_rates = (F.upper("currency") == "USD") & F.col("statement_fx").isNotNull() & F.col("last_fx").isNotNull()
    rows = rows.withColumns({
        "stmt_value_base": F.when(both_rates, F.col("stmt_value") * F.col("statement_fx")),
        "today_value_base": F.when(both_rates, F.col("today_value") * F.col("last_fx")),
    })
    return rows.select(
        *PORTFOLIO, "ticker", "label", "weight", "weight_basis", "stmt_value", "stmt_price", "today_price",
        "accrued_days", "ret", "today_value", (F.col("today_value") - F.col("stmt_value")).alias("delta"),
        "stmt_value_base", "today_value_base",
        (F.col("today_value_base") - F.col("stmt_value_base")).alias("delta_base"),
    )


def cum_dollars(periods: DataFrame, aum: DataFrame) -> DataFrame:
    """Money equivalent of each period's return."""
    return periods.join(aum.select("book_id", "aum"), "book_id").withColumn("cum_dollar", F.col("cum_return") * F.col("aum"))
