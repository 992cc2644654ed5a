"""Fill-aware bar backtest with optional entry delay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.ordered import Lane, drop_borrowed, lay_out, running
from barledger.operators.signals import average_sweep, signal_from_average, trend_signal

FLAT = "None"


def delay_entries(signal: DataFrame, lane: Lane, bars: int) -> DataFrame:
    """Enter every trade ``bars`` bars later; drop trades of at most ``bars + 1`` bars.

    A trade runs from its entry bar to its exit bar. Only the neighbourhood of ``bars + 1`` rows
    decides what happens to a row, so no running state is needed.
    """
    if bars <= 0:
        return signal
    w, reach = lane.window(), bars + 1
    in_trade = F.col("cycle") != FLAT
    next_enter, next_in = F.lead("enter", 1, 0).over(w), F.lead(in_trade, 1, False).over(w)
    out = signal.withColumn("_at", F.row_number().over(w))
    out = out.withColumn("_ends", in_trade & ((next_enter == 1) | ~next_in))
    entered = F.max(F.when(F.col("enter") == 1, F.col("_at"))).over(w.rowsBetween(-reach, 0))
    ended = F.min(F.when(F.col("_ends"), F.col("_at"))).over(w.rowsBetween(0, reach))
    out = out.withColumns({"_age": F.col("_at") - entered, "_left": ended - F.col("_at")})
    early = in_trade & (F.col("_age") <= bars)
    # Without an end in sight the trade is long enough; beyond the reach it has survived already.
    short = in_trade & F.coalesce(F.col("_age") + F.col("_left") + 1 <= bars + 1, F.lit(False))
    flattened = short | (early & (F.col("_age") < bars))
    starts = early & (F.col("_age") == bars) & ~short
    flattened, starts = F.coalesce(flattened, F.lit(False)), F.coalesce(starts, F.lit(False))

    def pick(name: str, at_start) -> Column:
        flat = F.lit(FLAT) if name == "cycle" else F.lit(0)
        kept = F.when(flattened, flat)
        if at_start is not None:
            kept = kept.when(starts, F.lit(at_start))
        return kept.otherwise(F.col(name))

    return out.withColumns({
        "cycle": pick("cycle", "init"),
        "enter": pick("enter", 1),
        "exit": pick("exit", None),
        "signal_open": pick("signal_open", 0),
    }).drop("_at", "_ends", "_age", "_left")


def bar_returns(signal: DataFrame, lane: Lane, cost_bps: float = 0.0) -> DataFrame:
    """Best-case, worst-case and after-cost return of each bar, and the position flags.

    entry bar: open (worst: high) to close; exit bar: previous close to open (worst: low);
    held bar: previous close to close; otherwise 0.
    """
    w = lane.window()
    enters, leaves = F.col("enter") == 1, F.col("exit") == 1
    held = F.col("signal_open") == 1

    def by_cycle(entry_at: str, exit_at: str) -> Column:
        prev = F.col("_prev_close")
        return (
            F.when(enters, F.try_divide(F.col("close"), F.col(entry_at)) - 1)
            .when(leaves, F.try_divide(F.col(exit_at), prev) - 1)
            .when(held, F.try_divide(F.col("close"), prev) - 1)
            .otherwise(0.0)
        )

    out = signal.withColumn("_prev_close", F.lag("close").over(w)).withColumns({
        "return_mark_to_close": by_cycle("open", "open"),
        "return_conservative": by_cycle("high", "low"),
    })
    cost = F.when(enters | leaves, F.lit(cost_bps / 10_000)).otherwise(0.0)
    out = out.withColumns({
        "return_net": F.col("return_mark_to_close") - cost,
        "position_start": F.col("cycle").isin("exit", "held").cast("int"),
        "position_end": F.col("cycle").isin("init", "held").cast("int"),
    })
    x, prev, nxt = F.col("position_start"), F.lag("position_start").over(w), F.lead("position_start").over(w)
    boundary = prev.isNull() | ((prev == 1) & (x == 0)) | ((x == 0) & F.coalesce(nxt == 1, F.lit(False)))
    return out.withColumn("_boundary", boundary.cast("int")).drop("_prev_close")


def accumulate(returns: DataFrame, lane: Lane) -> DataFrame:
    """Equity curves and the trade cycle number."""
    return running(returns, lane, {
        "strategy_equity_mark_to_close": ("product", 1 + F.col("return_mark_to_close")),
        "strategy_equity_conservative": ("product", 1 + F.col("return_conservative")),
        "strategy_equity_net": ("product", 1 + F.col("return_net")),
        "trade_cycle_id": ("sum", F.col("_boundary")),
    }).drop("_boundary")


def bar_backtest(signal: DataFrame, lane: Lane, cost_bps: float = 0.0, entry_offset: int = 0) -> DataFrame:
    """Backtest a signal frame whose lane is whole (no borrowed rows needed)."""
    if lane.blocked:
        raise ValueError("a blocked signal frame has lost its borrowed rows; use run_backtest")
    delayed = delay_entries(signal, lane, entry_offset)
    return accumulate(bar_returns(delayed, lane, cost_bps), lane)


def run_backtest(
    bars: DataFrame,
    ma_window: int = 200,
    cost_bps: float = 0.0,
    entry_offset: int = 0,
    trim_start=None,
    keys=("symbol",),
    timeframe: str = "1m",
    with_age: bool = False,
    **layout,
) -> tuple[DataFrame, Lane]:
    """Bars to backtest frame in one layout: finite-reach steps first, running ones after."""
    laid, lane = lay_out(
        bars, keys, "ts", timeframe, ma_window + entry_offset + 4, entry_offset + 3, **layout
    )
    return _from_signal(trend_signal(laid, lane, ma_window, trim_start), lane, cost_bps, entry_offset, with_age), lane


def run_sweep(
    bars: DataFrame,
    windows: Mapping[str, int],
    cost_bps: float = 0.0,
    entry_offset: int = 0,
    trim_start=None,
    keys=("symbol",),
    timeframe: str = "1m",
    with_age: bool = False,
    **layout,
) -> tuple[DataFrame, Lane]:
    """Backtest frames of many averaging lengths, named by ``variant``, from one scan of the bars."""
    reach = max(windows.values()) + entry_offset + 4
    laid, lane = lay_out(bars, keys, "ts", timeframe, reach, entry_offset + 3, **layout)
    averaged, lane = average_sweep(laid, lane, windows)
    return _from_signal(signal_from_average(averaged, lane, trim_start), lane, cost_bps, entry_offset, with_age), lane


def _from_signal(signal: DataFrame, lane: Lane, cost_bps: float, entry_offset: int, with_age: bool) -> DataFrame:
    if with_age:
        signal = signal.withColumn("_flat", (F.col("signal_open") == 0) & (F.col("exit") == 0))
    signal = delay_entries(signal, lane, entry_offset)
    returns = drop_borrowed(bar_returns(signal, lane, cost_bps), lane)
    if with_age:
        returns = running(returns, lane, {"signal_age": ("since", F.col("_flat"))}).drop("_flat")
    return accumulate(returns, lane)
