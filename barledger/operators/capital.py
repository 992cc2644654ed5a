"""Allocation view of a backtest: per-symbol summary and three portfolio capital models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.ordered import Lane, drop_borrowed, lay_out, running
from barledger.operators.fills import FLAT
from barledger.operators.trades import trade_bars
from barledger.schema import FILL_METHODS

#: Sums over symbols are exact decimals: they do not depend on the order in which rows arrive, so a
#: portfolio without a position has the same equity on every bar.
EXACT = "decimal(38,18)"


def with_group_total(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one total row per group; without group keys the total is a single row."""
    if keys:
        return df.join(totals, list(keys))
    return df.crossJoin(F.broadcast(totals))


def universe_size(backtest: DataFrame, lane: Lane) -> DataFrame:
    keys = lane.group_keys
    agg = F.count_distinct("symbol").alias("_universe")
    return backtest.groupBy(*keys).agg(agg) if keys else backtest.agg(agg)


def equity(backtest: DataFrame, lane: Lane, method: str = "mtc") -> DataFrame:
    """Equity curves, long. Pivot on a known symbol list at the edge if a wide frame is wanted."""
    return backtest.select(*lane.keys, lane.order, F.col(FILL_METHODS[method][1]).alias("equity"))


def equity_wide(backtest: DataFrame, lane: Lane, symbols: Sequence[str], method: str = "mtc") -> DataFrame:
    return (
        equity(backtest, lane, method).groupBy(*lane.group_keys, lane.order)
        .pivot("symbol", list(symbols)).agg(F.first("equity"))
    )


def allocation_summary(backtest: DataFrame, lane: Lane) -> DataFrame:
    """Final returns, drawdowns, trade counts and time invested per symbol."""
    peaked = running(backtest, lane, {
        f"_peak_{m}": ("max", F.col(FILL_METHODS[m][1])) for m in ("mtc", "conservative")
    })
    final = {
        f"return_{m}": F.max_by(FILL_METHODS[m][1], lane.order) - 1 for m in ("mtc", "conservative", "net")
    }
    invested = F.count_if(F.col("cycle") != FLAT)
    cols: dict[str, Column] = {
        **final,
        "entries": F.sum("enter"),
        "exits": F.sum("exit"),
        "invested_days": invested,
        "pct_invested": invested / F.count(F.lit(1)) * 100,
    }
    for m in ("mtc", "conservative"):
        dd = F.col(FILL_METHODS[m][1]) / F.col(f"_peak_{m}") - 1
        cols[f"max_drawdown_{m}"] = F.min(dd)
        cols[f"avg_drawdown_{m}"] = F.coalesce(F.avg(F.when(dd < 0, dd)), F.lit(0.0))
    return peaked.groupBy(*lane.keys).agg(*[c.alias(n) for n, c in cols.items()])


def _portfolio_lane(df: DataFrame, lane: Lane, layout: dict) -> tuple[DataFrame, Lane]:
    """Layout of the combined curve: one row per timestamp and group, bars as wide as those of ``lane``."""
    if not lane.group_keys:
        df = df.withColumn("book", F.lit("all"))
    return lay_out(df, lane.group_keys or ("book",), lane.order, lane.timeframe, 1, 1, **layout)


def portfolio_curve(
    backtest: DataFrame,
    lane: Lane,
    method: str = "mtc",
    mode: str = "rebalanced",
    amount_per_entry: float = 1000.0,
    **layout,
) -> DataFrame:
    """Returns and equity of the equal-weight portfolio, one row per timestamp.

    ``rebalanced`` resets every symbol to 1/N each bar; ``buy_and_hold`` averages the equity of the
    symbols that have a bar; ``fixed_stake`` stakes one amount per entry and books profits as cash.
    Symbols are summed by timestamp first (partial aggregation), so windows see one row per bar.
    """
    if mode == "rebalanced":
        return _rebalanced(backtest, lane, method, layout)
    if mode == "buy_and_hold":
        return _buy_and_hold(backtest, lane, method, layout)
    if mode == "fixed_stake":
        return _fixed_stake(backtest, lane, method, amount_per_entry, layout)
    raise ValueError(f"unknown capital mode {mode!r}")


def _rebalanced(backtest: DataFrame, lane: Lane, method: str, layout: dict) -> DataFrame:
    held = F.when(F.col("cycle") != FLAT, F.col(FILL_METHODS[method][0]))
    per_ts = backtest.groupBy(*lane.group_keys, lane.order).agg(
        F.coalesce(F.sum(held), F.lit(0.0)).alias("_sum")
    )
    per_ts = with_group_total(per_ts, universe_size(backtest, lane), lane.group_keys)
    per_ts, book = _portfolio_lane(per_ts.withColumn("ret", F.col("_sum") / F.col("_universe")), lane, layout)
    out = running(drop_borrowed(per_ts, book), book, {"equity": ("product", 1 + F.col("ret"))})
    return out.select(*lane.group_keys, lane.order, "ret", "equity")


def _with_change(curve: DataFrame, lane: Lane, layout: dict) -> DataFrame:
    """Simple change of the equity, 0 on the first bar."""
    laid, book = _portfolio_lane(curve, lane, layout)
    before = F.lag("equity").over(book.window())
    change = F.coalesce(F.try_divide(F.col("equity"), before) - 1, F.lit(0.0))
    return drop_borrowed(laid.withColumn("ret", change), book).select(*lane.group_keys, lane.order, "ret", "equity")


def _buy_and_hold(backtest: DataFrame, lane: Lane, method: str, layout: dict) -> DataFrame:
    own = F.col(FILL_METHODS[method][1])
    mean = F.sum(own.cast(EXACT)).cast("double") / F.count(own)
    return _with_change(backtest.groupBy(*lane.group_keys, lane.order).agg(mean.alias("equity")), lane, layout)


def _fixed_stake(backtest: DataFrame, lane: Lane, method: str, amount: float, layout: dict) -> DataFrame:
    gain = ((F.col(f"_growth_{method}") - 1) * amount).cast(EXACT)
    zero = F.lit(0).cast(EXACT)
    closing = F.when(F.col("cycle") == "exit", gain).otherwise(zero)
    at = [*lane.group_keys, lane.order]
    gains = trade_bars(backtest, lane, (method,)).select(*at, gain.alias("_open"), closing.alias("_closing"))
    # Every timestamp of the data counts, also those on which no symbol is in a trade. The zeros read
    # only keys, so Catalyst prunes the signal and backtest windows from their branch.
    clock = backtest.select(*at, zero.alias("_open"), zero.alias("_closing"))
    per_ts = gains.unionByName(clock).groupBy(*at).agg(
        F.sum("_open").alias("_open"), F.sum("_closing").alias("_closing")
    )
    per_ts, book = _portfolio_lane(per_ts, lane, layout)
    booked = running(drop_borrowed(per_ts, book), book, {"_booked": ("sum", F.col("_closing"))})
    booked = with_group_total(booked, universe_size(backtest, lane), lane.group_keys)
    stake = F.lit(amount) * F.col("_universe")
    nav = stake + (F.col("_open") + F.col("_booked") - F.col("_closing")).cast("double")
    curve = booked.select(*lane.group_keys, lane.order, (nav / stake).alias("equity"))
    return _with_change(curve, lane, layout)

