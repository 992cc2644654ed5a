"""Moving-average trend signal and its on-intervals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from barledger.functions.ordered import Lane, drop_borrowed, lay_out, rolling_mean, running
from barledger.schema import require_columns


def trend_signal(bars: DataFrame, lane: Lane, ma_window: int = 200, trim_start=None) -> DataFrame:
    """Long while the close is above its moving average, acted on at the next open.

    ``trim_start`` drops warm-up bars between the average and the edge detection, so a position
    already on at that time starts as a fresh entry. Every step uses the lane's one window
    specification, hence one shuffle and one sort. Borrowed rows stay in the frame; only
    ``signal_age`` (see :func:`signal_age`) needs them gone.
    """
    require_columns(bars, *lane.keys, lane.order, "close")
    return signal_from_average(bars.withColumn("ma", rolling_mean(F.col("close"), lane, ma_window)), lane, trim_start)


def signal_from_average(averaged: DataFrame, lane: Lane, trim_start=None) -> DataFrame:
    """Signal, edges and cycle of bars that carry their average ``ma`` (see :func:`trend_signal`)."""
    w = lane.window()
    out = averaged.withColumn(
        "signal_close", F.coalesce(F.col("close") > F.col("ma"), F.lit(False)).cast("int")
    )
    out = out.withColumn("signal_open", F.lag("signal_close", 1, 0).over(w))
    if trim_start is not None:
        out = out.where(F.col(lane.order) >= F.lit(trim_start).cast("timestamp_ntz"))
    on, before = F.col("signal_open"), F.lag("signal_open", 1, 0).over(w)
    out = out.withColumn("trade_direction", on - before)
    enter, leave = F.col("trade_direction") == 1, F.col("trade_direction") == -1
    return out.withColumns({
        "turnover": F.abs("trade_direction"),
        "enter": enter.cast("int"),
        "exit": leave.cast("int"),
        "cycle": F.when(enter, "init").when(leave, "exit").when(on == 1, "held").otherwise("None"),
    })


def average_sweep(bars: DataFrame, lane: Lane, windows: Mapping[str, int]) -> tuple[DataFrame, Lane]:
    """Every bar once per variant, with the variant's moving average ``ma`` of the close.

    All averages of a series come from one running sum and one running count, read ``n`` rows apart, in
    one window step: the bars are scanned, shuffled and sorted once for any number of variants. Sums
    run within the lane's window (a block in the split layout), which keeps them short. The rows are
    then dealt by (variant, series), so a sweep over few symbols still fills the cluster.
    """
    require_columns(bars, *lane.keys, lane.order, "close")
    upto, w = lane.upto(), lane.window()
    summed = bars.withColumns({"_sum": F.sum("close").over(upto), "_seen": F.count("close").over(upto)})
    lags = {n: (F.coalesce(F.lag("_sum", n).over(w), F.lit(0.0)), F.coalesce(F.lag("_seen", n).over(w), F.lit(0))) for n in set(windows.values())}
    summed = summed.withColumns({f"_{kind}{n}": c for n, pair in lags.items() for kind, c in zip(("sum", "seen"), pair)})
    mean = {n: F.when(F.col("_seen") - F.col(f"_seen{n}") == n, (F.col("_sum") - F.col(f"_sum{n}")) / n) for n in lags}
    each = F.array(*[F.struct(F.lit(v).alias("variant"), mean[n].alias("ma")) for v, n in windows.items()])
    rows = summed.select(*bars.columns, F.inline(each))
    swept = replace(lane, keys=("variant", *lane.keys))
    return rows.repartition(*swept.keys), swept


def signal_age(signal: DataFrame, lane: Lane, name: str = "signal_age") -> DataFrame:
    """Bars in the active streak, exit bar included; 0 when flat.

    An exit bar directly followed by a new entry does not reset the count.
    """
    flat = (F.col("signal_open") == 0) & (F.col("exit") == 0)
    return running(signal, lane, {name: ("since", flat)})


def run_trend_signal(
    bars: DataFrame,
    ma_window: int = 200,
    trim_start=None,
    keys=("symbol",),
    timeframe: str = "1m",
    **layout,
) -> tuple[DataFrame, Lane]:
    """Lay out, signal, age: the complete signal frame and its lane."""
    laid, lane = lay_out(bars, keys, "ts", timeframe, ma_window + 2, 1, **layout)
    signal = drop_borrowed(trend_signal(laid, lane, ma_window, trim_start), lane)
    return signal_age(signal, lane), lane


def on_intervals(signal: DataFrame, lane: Lane) -> DataFrame:
    """Per symbol, each stretch with the signal on: first on bar to first off bar.

    A stretch still open ends at the series' last bar.
    """
    on = F.col("signal_open") == 1
    starts = running(signal, lane, {"run": ("sum", F.col("enter"))})
    last = signal.groupBy(*lane.keys).agg(F.max(lane.order).alias("_last"))
    spans = (
        starts.where(on | (F.col("exit") == 1))
        .groupBy(*lane.keys, "run")
        .agg(
            F.min(F.when(on, F.col(lane.order))).alias("on_from"),
            F.min(F.when(F.col("exit") == 1, F.col(lane.order))).alias("_off"),
        )
    )
    return spans.join(last, list(lane.keys)).select(
        *lane.keys, "on_from", F.coalesce("_off", "_last").alias("on_to")
    )
