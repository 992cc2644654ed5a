"""Target weights from signals, and the value of books that hold them from bar to bar.

A book that returns to given weights on every bar has a closed form: its return is the weighted
return of the bar, its cost a share of the turnover, its value a running product. Books and bars are
joins and aggregations; no account is stepped through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barledger.functions.execution import FIXED_BPS
from barledger.functions.ordered import Lane, drop_borrowed, lay_out, running
from barledger.operators.asof import as_of_single
from barledger.operators.capital import universe_size, with_group_total
from barledger.operators.metrics import panel_returns

#: Changes of weight below this are the rounding of the drift, not trades.
LEAST_TRADE = 1e-9


def signal_weights(signal: DataFrame, lane: Lane, timestamps: DataFrame | None = None) -> DataFrame:
    """1/N of the universe for every symbol with the signal on.

    ``timestamps`` (``ts``) asks for other times: the latest panel timestamp at or before each is used.
    """
    on = signal.where(F.col("signal_open") == 1).select(*lane.keys, lane.order)
    weights = with_group_total(on, universe_size(signal, lane), lane.group_keys).select(
        *lane.keys, lane.order, (1 / F.col("_universe")).alias("weight")
    )
    if timestamps is None:
        return weights
    panel = signal.select(F.col(lane.order).alias("_panel")).distinct()
    quotes = panel.select(F.col("_panel").alias("ts"), F.col("_panel").alias("v"))
    asked = as_of_single(timestamps.select("ts").distinct(), quotes, "ts", "v", "_at", timeframe=lane.timeframe).select("ts", "_at")
    return weights.withColumnRenamed(lane.order, "_at").join(asked, "_at").select(*lane.keys, "ts", "weight")


def weight_changes(bars: DataFrame, weights: DataFrame, keys: Sequence[str] = ("variant",), timeframe: str = "1m", **layout) -> DataFrame:
    """Per book, bar and symbol: ``held`` (weight after the bar's drift), ``target``, ``change``, and the book's ``gross`` return.

    ``weights`` holds ``keys, ts, symbol, weight``; a symbol without a weight on a bar is sold there,
    what is not in symbols is cash. Weights of a bar earn the return of the next bar of the panel; a
    symbol without a price on either has no return there.
    """
    calendar, lane = lay_out(bars.select("ts").distinct().withColumn("_all", F.lit(0)), ["_all"], "ts", timeframe, 0, 1, **layout)
    following = drop_borrowed(calendar.withColumn("_next", F.lead("ts").over(lane.window())), lane).select("ts", "_next")
    steps = panel_returns(bars, ("symbol",), timeframe=timeframe, **layout).select("symbol", "ts", "ret")
    held = weights.join(following, "ts").where("_next is not null").select(*keys, F.col("_next").alias("ts"), "symbol", F.col("weight").alias("before"))
    held = held.join(steps, ["symbol", "ts"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    gross = held.groupBy(*keys, "ts").agg(F.sum(F.col("before") * F.col("ret")).alias("gross"))
    at = [*keys, "ts", "symbol"]
    both = held.select(*at, (F.col("before") * (1 + F.col("ret"))).alias("grown")).join(weights.select(*at, F.col("weight").alias("target")), at, "full")
    drift = F.coalesce(F.col("grown") / (1 + F.col("gross")), F.lit(0.0))
    rows = both.join(gross, [*keys, "ts"], "left").withColumn("gross", F.coalesce("gross", F.lit(0.0)))
    rows = rows.withColumns({"held": drift, "target": F.coalesce("target", F.lit(0.0))})
    return rows.select(*at, "held", "target", (F.col("target") - F.col("held")).alias("change"), "gross")


def held_nav(bars: DataFrame, weights: DataFrame, keys: Sequence[str] = ("variant",), capital: float = 1_000_000.0,
             cost_bps: float = FIXED_BPS, timeframe: str = "1m", **layout) -> DataFrame:
    """``keys, ts, gross, turnover, nav`` of each book; a bar on which it neither holds nor trades has no row.

    The value grows by the return of the weights held and pays ``cost_bps`` on the traded share.
    """
    changes = weight_changes(bars, weights, keys, timeframe, **layout)
    per_bar = changes.groupBy(*keys, "ts").agg(F.first("gross").alias("gross"), F.sum(F.abs("change")).alias("turnover"))
    laid, lane = lay_out(per_bar, keys, "ts", timeframe, **layout)
    step = (1 + F.col("gross")) * (1 - F.col("turnover") * (cost_bps / 10_000))
    grown = running(drop_borrowed(laid, lane), lane, {"growth": ("product", step)})
    return grown.select(*keys, "ts", "gross", "turnover", (capital * F.col("growth")).alias("nav"))


def held_trades(bars: DataFrame, weights: DataFrame, nav: DataFrame, keys: Sequence[str] = ("variant",), timeframe: str = "1m", **layout) -> DataFrame:
    """``keys, ts, symbol, change, notional``: the trades behind ``nav``, valued at the book's value after the bar."""
    changes = weight_changes(bars, weights, keys, timeframe, **layout).where(F.abs("change") > LEAST_TRADE)
    rows = changes.join(nav.select(*keys, "ts", "nav"), [*keys, "ts"])
    return rows.select(*keys, "ts", "symbol", "change", (F.col("change") * F.col("nav")).alias("notional"))
