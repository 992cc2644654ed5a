"""Portfolio and book return series rebuilt from holdings and ticker returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.calendars import calendar_days
from barledger.functions.ordered import drop_borrowed, lay_out, running, unblock
from barledger.operators.book import CASH_PREFIX, with_role
from barledger.schema import PERIODS_PER_YEAR

SERIES = ["book_id", "name"]


def cash_returns(returns: DataFrame, holding: DataFrame) -> DataFrame:
    """Ticker returns plus zero returns for every cash ticker held, on the same timestamps.

    Rows that ``returns`` itself has for cash tickers give way. The distinct cash tickers are
    currency codes; they travel as one array row.
    """
    returns = returns.where(~F.startswith("ticker", F.lit(CASH_PREFIX)))
    cash = holding.where(F.startswith("ticker", F.lit(CASH_PREFIX))).agg(F.collect_set("ticker").alias("_cash"))
    spine = returns.select("ts").distinct().crossJoin(F.broadcast(cash))
    zeros = spine.select("ts", F.explode("_cash").alias("ticker"), F.lit(0.0).alias("ret"))
    return returns.select("ts", "ticker", "ret").unionByName(zeros)


def business_day_cash(spans: DataFrame, first: str, last: str) -> DataFrame:
    """Zero returns of cash tickers over a weekday spine when there are no other returns."""
    days = calendar_days(spans, first, last, "day", weekdays_only=True)
    return days.select(F.col("day").cast("timestamp_ntz").alias("ts"), "ticker", F.lit(0.0).alias("ret"))


def ticker_weights(holding: DataFrame) -> DataFrame:
    """Weights summed per ticker and scaled to one, with the number of tickers to expect."""
    summed = holding.groupBy(*SERIES, "ticker").agg(F.sum("weight").alias("weight"))
    total = summed.groupBy(*SERIES).agg(F.sum("weight").alias("_total"), F.count(F.lit(1)).alias("n_tickers"))
    scaled = F.try_divide(F.col("weight"), F.col("_total"))
    return summed.join(total, SERIES).select(*SERIES, "ticker", scaled.alias("weight"), "n_tickers")


def fx_adjusted(ret: Column, fx_change: Column) -> Column:
    return (1 + ret) * (1 + fx_change) - 1


def portfolio_returns(
    portfolio: DataFrame,
    holding: DataFrame,
    returns: DataFrame,
    fx: DataFrame | None = None,
    timeframe: str = "1m",
    strict: bool = False,
    on_reject: str = "raise",
    **layout,
) -> DataFrame:
    """Weighted return per portfolio on the timestamps where all of its tickers have one.

    Less the daily fee; USD portfolios are compounded with the currency change if ``fx`` is given.
    Cash tickers have a return of zero on every timestamp. All portfolios of all books are one
    aggregation. ``strict`` fails on any gap. A ticker without any return, or weights that sum to
    zero, fail the job when its rows are read; with ``on_reject="drop"`` such portfolios have no rows
    (``portfolio_rejects`` names them).
    """
    if on_reject not in ("raise", "drop"):
        raise ValueError(f"unknown choice {on_reject!r}")
    known = cash_returns(returns.where(F.col("ret").isNotNull()), holding)
    weights = ticker_weights(holding)
    rejects = portfolio_rejects(holding, known)
    if on_reject == "drop":
        weights = weights.join(rejects, SERIES, "left_anti")
    else:
        why = F.concat(F.lit("portfolio "), F.col("name"), F.lit(": "), F.col("reason"))
        sound = F.when(F.col("reason").isNull(), F.col("weight")).otherwise(F.raise_error(why).cast("double"))
        weights = weights.join(rejects, SERIES, "left").withColumn("weight", sound).drop("reason")
    rows = known.join(weights, "ticker", "right").groupBy(*SERIES, "ts").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("ret"),
        F.count(F.lit(1)).alias("_have"),
        F.first("n_tickers").alias("_need"),
    ).where(F.col("ts").isNotNull())
    complete = F.col("_have") == F.col("_need")
    if strict:
        gap = F.concat(F.lit("tickers with gaps in "), F.col("name"))
        complete = F.when(complete, True).otherwise(F.raise_error(gap).cast("boolean"))
    rows = rows.where(complete).drop("_have", "_need")
    facts = portfolio.select(*SERIES, "ord", "fee_annual", "currency")
    rows = rows.join(facts, SERIES).withColumn(
        "ret", F.col("ret") - F.coalesce("fee_annual", F.lit(0.0)) / PERIODS_PER_YEAR
    )
    if fx is not None:
        rows = _with_currency(rows, fx, timeframe, layout)
    return rows.select(*SERIES, "ord", "ts", "ret")


def portfolio_rejects(holding: DataFrame, returns: DataFrame) -> DataFrame:
    """``book_id, name, reason`` of portfolios that cannot have returns: tickers without any, or weights that sum to zero."""
    tickers = returns.where(F.col("ret").isNotNull()).select("ticker").distinct()
    cash = F.startswith("ticker", F.lit(CASH_PREFIX))
    missing = holding.where(~cash).join(tickers, "ticker", "left_anti").groupBy(*SERIES).agg(
        F.concat(F.lit("no returns for "), F.array_join(F.array_sort(F.collect_set("ticker")), ", ")).alias("missing"))
    sums = holding.groupBy(*SERIES).agg((F.sum("weight") == 0).alias("zero"))
    reason = F.coalesce("missing", F.when(F.col("zero"), F.lit("weights sum to zero")))
    return sums.join(missing, SERIES, "left").select(*SERIES, reason.alias("reason")).where(F.col("reason").isNotNull())


def _with_currency(rows: DataFrame, fx: DataFrame, timeframe: str, layout: dict) -> DataFrame:
    """Currency rates on the return timestamps, filled forward, then backward before the first.

    The change of the rate looks one row back, also across a block border, so the filled series is
    laid out once more with that reach.
    """
    usd = F.upper("currency") == "USD"
    rated = rows.join(fx.select("ts", "rate"), "ts", "left")
    laid, lane = lay_out(rated, SERIES, "ts", timeframe, **layout)
    laid = unblock(running(drop_borrowed(laid, lane), lane, {"_filled": ("last", F.col("rate"))}), lane)
    first = rated.groupBy(*SERIES).agg(F.min_by("rate", F.when(F.col("rate").isNotNull(), F.col("ts"))).alias("_first"))
    filled = laid.join(first, SERIES).withColumn("_filled", F.coalesce("_filled", "_first"))
    filled, lane = lay_out(filled, SERIES, "ts", timeframe, 1, 0, **layout)
    before = F.lag("_filled").over(lane.window())
    change = F.coalesce(F.try_divide(F.col("_filled"), before) - 1, F.lit(0.0))
    return drop_borrowed(filled.withColumn("_change", change), lane).withColumn(
        "ret", F.when(usd, fx_adjusted(F.col("ret"), F.col("_change"))).otherwise(F.col("ret"))
    )


def returns_panel(portfolio, holding, returns, fx=None, timeframe: str = "1m", role: str = "holding",
                  strict: bool = False, **layout) -> DataFrame:
    """Long panel of all portfolios with ``role``; one without a complete timestamp has no rows.

    ``strict`` fails where a portfolio would be dropped for its tickers or weights.
    """
    held = with_role(portfolio, role)
    own = holding.join(held.select(*SERIES), SERIES, "left_semi")
    return portfolio_returns(held, own, returns, fx, timeframe, on_reject="raise" if strict else "drop", **layout)


def dropped_portfolios(portfolio: DataFrame, holding: DataFrame, returns: DataFrame, panel: DataFrame) -> DataFrame:
    """Portfolios missing from the panel and why."""
    held = with_role(portfolio)
    lacking = (
        holding.join(returns.where(F.col("ret").isNotNull()).select("ticker").distinct(), "ticker", "left_anti")
        .groupBy(*SERIES).agg(F.array_join(F.array_sort(F.collect_set("ticker")), ", ").alias("_missing"))
    )
    gone = held.select(*SERIES).join(panel.select(*SERIES).distinct(), SERIES, "left_anti").join(lacking, SERIES, "left")
    reason = F.when(F.col("_missing").isNotNull(), F.concat(F.lit("no returns for "), "_missing"))
    return gone.select(*SERIES, reason.otherwise("no common history").alias("reason"))


def common_start(panel: DataFrame) -> DataFrame:
    """Per book, the latest first date of its series."""
    starts = panel.where(F.col("ret").isNotNull()).groupBy(*SERIES).agg(F.min("ts").alias("_first"))
    return starts.groupBy("book_id").agg(F.max("_first").alias("common_start"))


def aligned_panel(panel: DataFrame) -> DataFrame:
    """Rows of the timestamps on which every series of the book has a return."""
    size = panel.groupBy("book_id").agg(F.count_distinct("name").alias("_series"))
    full = panel.groupBy("book_id", "ts").agg(F.count("ret").alias("_have")).join(size, "book_id")
    return panel.join(full.where(F.col("_have") == F.col("_series")).select("book_id", "ts"), ["book_id", "ts"], "left_semi")


def book_returns(panel: DataFrame, values: DataFrame, aligned: bool = True) -> DataFrame:
    """Book return per timestamp, weights proportional to portfolio value.

    Aligned: complete timestamps only. Otherwise weights are rescaled over the portfolios present.
    """
    weights = values.join(panel.select(*SERIES).distinct(), SERIES, "left_semi").select(*SERIES, "value_base")
    size = weights.groupBy("book_id").agg(F.sum("value_base").alias("_total"), F.count(F.lit(1)).alias("_series"))
    rows = panel.where(F.col("ret").isNotNull()).join(weights, SERIES).groupBy("book_id", "ts").agg(
        F.sum(F.col("value_base") * F.col("ret")).alias("_sum"),
        F.sum("value_base").alias("_present"),
        F.count(F.lit(1)).alias("_have"),
    )
    if not aligned:
        return rows.select("book_id", "ts", (F.col("_sum") / F.col("_present")).alias("ret"))
    rows = rows.join(size, "book_id").where(F.col("_have") == F.col("_series"))
    return rows.select("book_id", "ts", (F.col("_sum") / F.col("_total")).alias("ret"))
