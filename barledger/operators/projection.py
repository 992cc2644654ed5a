"""Value of portfolios after their statement: target segments, piecewise value, daily NAV panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.functions.calendars import calendar_days
from barledger.operators.asof import as_of, fill_to_calendar, target_intervals
from barledger.operators.book import CASH_PREFIX, is_cash_like, with_role
from barledger.schema import DAILY

SEGMENT_TOLERANCE = 0.05
PORTFOLIO = ["book_id", "name"]
SEGMENT = [*PORTFOLIO, "seg_start", "seg_end"]


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier)


def fee_factor(fee: Column, start: Column, end: Column) -> Column:
    """Linear fee: one minus the yearly fee times the elapsed part of a year."""
    days = F.greatest(days_between(end, start), F.lit(0))
    return 1 - F.coalesce(fee, F.lit(0.0)) * days / 365.0


def accrual(first: Column, last: Column, known_days: Column, missing_days: Column) -> Column:
    """Growth over the missing days at the yield realised over the known days."""
    yearly = F.pow(last / first, 365.0 / F.greatest(known_days, F.lit(1)))
    return F.when(missing_days > 0, F.pow(yearly, missing_days / 365.0)).otherwise(1.0)


def segments(portfolio: DataFrame, targets: DataFrame, end: Column) -> DataFrame:
    """Cut (statement date, end] of each holding portfolio where its target changes.

    ``eff_date`` is the snapshot in force at the segment start; NULL means statement weights,
    because there is none or its weights do not sum to one.
    """
    held = with_role(portfolio).withColumn("_end", end.cast("date")).where(F.col("statement_date") <= F.col("_end"))
    snapshots = target_intervals(targets)
    span = held.select(*PORTFOLIO, "statement_date", "_end")
    inside = (F.col("eff_date") > F.col("statement_date")) & (F.col("eff_date") <= F.col("_end"))
    changes = span.join(snapshots, "name").where(inside).select(*PORTFOLIO, "_end", F.col("eff_date").alias("seg_start"))
    starts = span.select(*PORTFOLIO, "_end", F.col("statement_date").alias("seg_start")).unionByName(changes)
    following = F.lead("seg_start").over(Window.partitionBy(*PORTFOLIO).orderBy("seg_start"))
    cut = starts.withColumn("seg_end", F.coalesce(following, F.col("_end")))
    cut = cut.withColumn("is_last", following.isNull()).drop("_end")
    in_force = (F.col("seg_start") >= F.col("eff_date")) & (F.col("eff_to").isNull() | (F.col("seg_start") < F.col("eff_to")))
    found = cut.join(snapshots, "name").where(in_force & (F.abs(F.col("weight_sum") - 1) <= SEGMENT_TOLERANCE)).select(
        *PORTFOLIO, "seg_start", "eff_date"
    )
    return cut.join(found, [*PORTFOLIO, "seg_start"], "left").withColumn(
        "basis", F.when(F.col("eff_date").isNotNull(), "target").otherwise("statement")
    )


def segment_weights(cut: DataFrame, holding: DataFrame, targets: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights per segment. ``priced`` is false for cash placeholders and assets not held."""
    from_targets = cut.where("basis = 'target'").join(targets, ["name", "eff_date"]).select(*SEGMENT, "is_last", "ticker", "weight")
    from_statement = cut.where("basis = 'statement'").join(holding.select(*PORTFOLIO, "ticker", "weight"), PORTFOLIO).select(
        *SEGMENT, "is_last", "ticker", "weight"
    )
    owned = holding.select(*PORTFOLIO, "ticker").distinct().withColumn("_held", F.lit(True))
    assets = universe.select("ticker", is_cash_like().alias("cash_like"))
    rows = from_targets.unionByName(from_statement).where(F.col("weight") != 0)
    rows = rows.join(owned, [*PORTFOLIO, "ticker"], "left").join(assets, "ticker", "left")
    priced = F.coalesce("_held", F.lit(False)) & ~F.startswith("ticker", F.lit(CASH_PREFIX))
    return rows.withColumn("priced", priced).withColumn("cash_like", F.coalesce("cash_like", F.lit(False))).drop("_held")


def piecewise_values(
    portfolio: DataFrame, holding: DataFrame, universe: DataFrame, targets: DataFrame, prices: DataFrame, end: Column
) -> DataFrame:
    """Native value of each portfolio at ``end``: statement value times the segment factors and fee.

    ``prices`` holds ``ticker, ts, close``. A missing price leaves that holding unchanged.
    """
    rows = segment_weights(segments(portfolio, targets, end), holding, targets, universe)
    rows = as_of(rows, prices, ["ticker"], "seg_start", "close", "p0", timeframe=DAILY)
    rows = as_of(rows, prices, ["ticker"], "seg_end", "close", "p1", timeframe=DAILY)
    usable = F.col("priced") & (F.col("p0") > 0) & F.col("p1").isNotNull()
    d0, d1 = F.col("p0_ts").cast("date"), F.col("p1_ts").cast("date")
    stale = F.col("cash_like") & (d1 < F.col("seg_end"))
    grown = F.col("p1") * F.when(
        stale, accrual(F.col("p0"), F.col("p1"), days_between(d1, d0), days_between(F.col("seg_end"), d1))
    ).otherwise(1.0)
    factor = F.sum(F.col("weight") * F.when(usable, grown / F.col("p0")).otherwise(1.0))
    per_segment = rows.where(F.col("seg_end") > F.col("seg_start")).groupBy(*SEGMENT).agg(factor.alias("_factor"))
    chained = per_segment.groupBy(*PORTFOLIO).agg(F.product("_factor").alias("_chain"))
    held = with_role(portfolio).join(chained, PORTFOLIO, "left")
    fee = fee_factor(F.col("fee_annual"), F.col("statement_date"), end.cast("date"))
    return held.withColumn("today_native", F.col("total_value") * F.coalesce("_chain", F.lit(1.0)) * fee).drop("_chain")


def nav_panel(
    portfolio: DataFrame, holding: DataFrame, universe: DataFrame, targets: DataFrame, prices: DataFrame,
    fx: DataFrame | None, start: Column, end: Column,
) -> DataFrame:
    """Daily base-currency NAV per holding portfolio (``book_id, name, day, nav``).

    Inside a segment a portfolio is bought and held; segments are chained by their last-day value.
    On a boundary day the later segment counts. Days before the statement have no row.
    """
    rows = segment_weights(segments(portfolio, targets, end), holding, targets, universe)
    prices = prices.where(F.col("close").isNotNull() & (F.col("ts") <= end.cast("timestamp_ntz")))
    rows = as_of(rows, prices, ["ticker"], "seg_start", "close", "p0", timeframe=DAILY)
    visible = prices.where(F.col("ts") >= start.cast("timestamp_ntz"))
    ends = visible.groupBy("ticker").agg(
        F.min_by("close", "ts").alias("first_close"), F.min("ts").cast("date").alias("first_day"),
        F.max_by("close", "ts").alias("last_close"), F.max("ts").cast("date").alias("last_day"),
    )
    rows = rows.join(ends, "ticker", "left")
    daily = _daily_prices(rows, visible, start, end)
    span = calendar_days(
        rows.withColumn("_from", F.greatest(F.col("seg_start"), start.cast("date"))), "_from", "seg_end"
    ).join(daily, ["ticker", "day"], "left")

    # Before the first visible price the next one inside the segment is used.
    ahead = F.when(F.col("first_day") <= F.col("seg_end"), F.col("first_close"))
    price = F.coalesce("close", ahead)
    known, gap = days_between(F.col("last_day"), F.col("p0_ts").cast("date")), days_between(F.col("day"), F.col("last_day"))
    tail = F.when(
        F.col("cash_like") & (F.col("last_day") < F.col("seg_end")) & (F.col("last_close") > 0),
        accrual(F.col("p0"), F.col("last_close"), known, gap),
    ).otherwise(1.0)
    usable = F.col("priced") & (F.col("p0") > 0) & F.col("last_close").isNotNull()
    ratio = F.when(usable, price * tail / F.col("p0")).otherwise(1.0)
    factors = span.groupBy(*SEGMENT, "is_last", "day").agg(F.sum(F.col("weight") * ratio).alias("factor"))

    # One running product over the days of a portfolio: a segment hands on its last day's factor, its other days do not count.
    earlier = Window.partitionBy(*PORTFOLIO).orderBy("seg_start", "day").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = F.product(F.when(F.col("day") == F.col("seg_end"), F.col("factor"))).over(earlier)
    chained = factors.withColumn("_opening", F.coalesce(handed_on, F.lit(1.0)))
    shown = chained.where((F.col("day") < F.col("seg_end")) | F.col("is_last"))
    facts = with_role(portfolio).select(*PORTFOLIO, "total_value", "statement_date", "fee_annual", "currency", "statement_fx")
    nav = shown.join(facts, PORTFOLIO).withColumn(
        "nav", F.col("total_value") * F.col("_opening") * F.col("factor")
        * fee_factor(F.col("fee_annual"), F.col("statement_date"), F.col("day")),
    )
    if fx is None:
        return nav.select(*PORTFOLIO, "day", "nav")
    rates = daily_rates(fx, start, end)
    pinned = F.when(F.col("day") == F.col("statement_date"), F.col("statement_fx")).otherwise(F.col("rate"))
    usd = (F.upper("currency") == "USD") & F.col("statement_fx").isNotNull()
    return nav.join(rates, "day", "left").select(
        *PORTFOLIO, "day", F.when(usd, F.col("nav") * pinned).otherwise(F.col("nav")).alias("nav")
    )


def _spine(keys: DataFrame, start: Column, end: Column) -> DataFrame:
    spans = keys.withColumns({"_from": start.cast("date"), "_to": end.cast("date")})
    return calendar_days(spans, "_from", "_to").drop("_from", "_to").withColumn("ts", F.col("day").cast("timestamp_ntz"))


def _daily_prices(rows: DataFrame, visible: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closing prices of every calendar day, filled forward: one series per ticker, shared by all books."""
    spine = _spine(rows.select("ticker").distinct(), start, end)
    filled = fill_to_calendar(visible.select("ticker", "ts", "close"), spine.select("ticker", "ts"), ["ticker"], "close", timeframe=DAILY)
    return filled.select("ticker", F.col("ts").cast("date").alias("day"), "close")


def daily_rates(fx: DataFrame, start: Column, end: Column) -> DataFrame:
    """Currency rate of every calendar day, filled forward, then backward before the first."""
    one = fx.agg(F.lit(0).alias("_k"), F.count("*"))
    spine = _spine(one.select("_k"), start, end)
    filled = fill_to_calendar(fx.select(F.lit(0).alias("_k"), "ts", "rate"), spine.select("_k", "ts"), ["_k"], "rate", back_fill=True, timeframe=DAILY)
    return filled.select(F.col("ts").cast("date").alias("day"), "rate")


def book_nav_from_panel(panel: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Book NAV on the days on which every holding portfolio has one."""
    size = with_role(portfolio).groupBy("book_id").agg(F.count(F.lit(1)).alias("_size"))
    sums = panel.groupBy("book_id", "day").agg(F.sum("nav").alias("nav"), F.count("nav").alias("_have"))
    return sums.join(size, "book_id").where(F.col("_have") == F.col("_size")).select(
        "book_id", F.col("day").cast("timestamp_ntz").alias("ts"), "nav"
    )
