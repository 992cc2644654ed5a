"""Per-trade statistics, summaries, quality flags, paths and variant comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.functions.ordered import Lane, running, series_row_bound
from barledger.functions.quantiles import BUFFER_ROWS, exact_quantiles
from barledger.functions.stats import INF, compound, mean_where, sample_skewness, sum_where
from barledger.operators.fills import FLAT
from barledger.schema import FILL_METHODS

FLAG_NAMES = (
    "median_negative", "top_trade_outlier", "skewed_right", "skewed_left",
    "edge_reversed", "fill_halves_edge", "median_flips",
)
FIRST_BARS = 5
TOP_SHARE, SKEW_LIMIT, HALF = 0.3, 1.5, 0.5


def in_trade(backtest: DataFrame) -> DataFrame:
    return backtest.where(F.col("cycle") != FLAT)


def trade_bars(backtest: DataFrame, lane: Lane, methods: Sequence[str] = tuple(FILL_METHODS)) -> DataFrame:
    """In-trade bars with position in trade, and growth and peak per fill method since entry."""
    numbered = running(backtest, lane, {"trade_no": ("sum", F.col("enter"))})
    trade = lane.within("trade_cycle_id")
    grown = running(in_trade(numbered), trade, {
        "bar_no": ("sum", F.lit(1)),
        **{f"_growth_{m}": ("product", 1 + F.col(FILL_METHODS[m][0])) for m in methods},
    })
    return running(grown, trade, {f"_peak_{m}": ("max", F.col(f"_growth_{m}")) for m in methods})


def trade_stats(backtest: DataFrame, lane: Lane, methods: Sequence[str] = tuple(FILL_METHODS)) -> DataFrame:
    """One row per entry-to-exit cycle. The drawdown counts the entry price as the first peak."""
    bars = trade_bars(backtest, lane, methods)
    aggs: list[Column] = [
        F.first("trade_no").alias("trade_no"),
        F.min(lane.order).alias("entry_date"),
        F.max(lane.order).alias("exit_date"),
        F.count(F.lit(1)).alias("duration"),
    ]
    for m in methods:
        r = F.col(FILL_METHODS[m][0])
        early, late = F.col("bar_no") <= FIRST_BARS, F.col("bar_no") > FIRST_BARS
        fall = F.col(f"_growth_{m}") / F.greatest(F.lit(1.0), F.col(f"_peak_{m}")) - 1
        aggs += [
            compound(r).alias(f"return_{m}"),
            F.least(F.lit(0.0), F.min(fall)).alias(f"max_intra_drawdown_{m}"),
            compound(F.when(early, r)).alias(f"d5_{m}"),
            compound(F.when(late, r)).alias(f"d5_to_exit_{m}"),
        ]
    out = bars.groupBy(*lane.keys, "trade_cycle_id").agg(*aggs)
    label = F.concat("symbol", F.lit(" T"), F.col("trade_no").cast("string"))
    return out.withColumn("label", label).drop("trade_cycle_id")


def _summary_columns(ret: Column, dd: Column, single: Column) -> dict[str, Column]:
    """Thirteen statistics; ``single`` is the ex-top value of a one-trade group."""
    n = F.count(ret)
    won, lost = ret > 0, ret < 0
    win_rate = F.try_divide(F.count_if(won), n)
    avg_win, avg_loss = mean_where(ret, won), mean_where(ret, lost)
    losses = sum_where(ret, lost)
    return {
        "n_trades": n,
        "win_rate": win_rate,
        "avg_win": avg_win,
        "avg_loss": avg_loss,
        "expectancy": win_rate * avg_win + (1 - win_rate) * avg_loss,
        "expectancy_ex_top": F.when(n > 1, F.try_divide(F.sum(ret) - F.max(ret), n - 1)).otherwise(single),
        "profit_factor": F.when(losses != 0, sum_where(ret, won) / F.abs(losses)).otherwise(INF),
        "max_win": F.coalesce(F.max(F.when(won, ret)), F.lit(0.0)),
        "max_loss": F.coalesce(F.min(F.when(lost, ret)), F.lit(0.0)),
        "skewness": sample_skewness(ret),
        "avg_duration": F.avg("duration"),
        "avg_intra_drawdown": F.avg(dd),
        "max_intra_drawdown": F.min(dd),
    }


SUMMARY_COLUMNS = (
    "win_rate", "avg_win", "avg_loss", "expectancy", "expectancy_ex_top", "median_return",
    "profit_factor", "max_win", "max_loss", "skewness", "avg_duration", "avg_intra_drawdown",
    "max_intra_drawdown",
)


def trade_summary(
    stats: DataFrame, method: str = "net", keys: Sequence[str] = ("symbol",), timeframe: str = "1m"
) -> DataFrame:
    """Edge statistics per series. A series of daily bars bounds its trades, so the median comes from
    the same aggregation; for finer bars it is found in a distributed way (settle ``stats`` first)."""
    ret, dd = F.col(f"return_{method}"), F.col(f"max_intra_drawdown_{method}")
    cols = _summary_columns(ret, dd, F.lit(None).cast("double"))
    few = series_row_bound(timeframe) // 2 <= BUFFER_ROWS
    if few:
        cols["median_return"] = F.percentile(ret, 0.5)
    out = stats.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])
    if few:
        return out
    return out.join(exact_quantiles(stats, keys, f"return_{method}", {"median_return": 0.5}), list(keys))


def pooled_table(stats: DataFrame, method: str = "net", keys: Sequence[str] = ("variant",)) -> DataFrame:
    """The same statistics over all symbols of a variant; one trade is its own ex-top value."""
    ret, dd = F.col(f"return_{method}"), F.col(f"max_intra_drawdown_{method}")
    cols = _summary_columns(ret, dd, F.max(ret))
    pooled = stats.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])
    medians = exact_quantiles(stats, keys, f"return_{method}", {"median_return": 0.5})
    return pooled.join(medians, list(keys))


def symbol_table(stats: DataFrame, method: str = "net", timeframe: str = "1m") -> DataFrame:
    return trade_summary(stats, method, ("variant", "symbol"), timeframe)


def _timing_columns(method: str) -> dict[str, Column]:
    d5, tail = F.col(f"d5_{method}"), F.col(f"d5_to_exit_{method}")
    full, longer = F.col("duration") >= FIRST_BARS, F.col("duration") > FIRST_BARS
    n5, win5 = F.count_if(full), F.count_if(full & (d5 > 0))
    nt, wint = F.count_if(longer), F.count_if(longer & (tail > 0))
    return {
        "wr_d5": F.try_divide(win5, n5), "wr_d5_n": n5, "wr_d5_nwin": win5,
        "wr_tail": F.try_divide(wint, nt), "wr_tail_n": nt, "wr_tail_nwin": wint,
    }


def d5_stats(stats: DataFrame, method: str = "net", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Win rates at bar five and from there to the exit; NULL without qualifying trades."""
    return stats.groupBy(*keys).agg(*[c.alias(n) for n, c in _timing_columns(method).items()])


def with_quality_flags(summary: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Seven warning flags on a (keys, method) summary; three compare with the net row."""
    same = Window.partitionBy(*keys)
    is_net = F.col("method") == "net"
    exp, med, skew = F.col("expectancy"), F.col("median_return"), F.col("skewness")
    net_exp = F.max(F.when(is_net, exp)).over(same)
    net_med = F.max(F.when(is_net, med)).over(same)
    share = F.when(exp > 0, F.abs(exp - F.col("expectancy_ex_top")) / F.abs(exp))
    rules = {
        "median_negative": (exp > 0) & (med < 0),
        "top_trade_outlier": (exp > 0) & (share > TOP_SHARE),
        "skewed_right": skew > SKEW_LIMIT,
        "skewed_left": skew < -SKEW_LIMIT,
        "edge_reversed": ~is_net & (net_exp > 0) & (exp <= 0),
        "fill_halves_edge": ~is_net & (net_exp > 0) & (exp > 0) & (exp < net_exp * HALF),
        "median_flips": ~is_net & (net_med >= 0) & (med < 0),
    }
    return summary.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in rules.items()})


def flag_text() -> Column:
    """Fired flags in words, joined by commas; a dash if none fired."""
    words = [
        F.when(F.col("median_negative"), "median < 0"),
        F.when(F.col("top_trade_outlier"), "top trade > 30%"),
        F.when(F.col("skewed_right"), "right-skewed").when(F.col("skewed_left"), "left-skewed"),
        F.when(F.col("edge_reversed"), "edge reverses").when(F.col("fill_halves_edge"), "fill halves edge"),
        F.when(F.col("median_flips"), "median flips"),
    ]
    text = F.concat_ws(", ", *words)
    return F.when(text == "", F.lit("—")).otherwise(text)


def quality_table(
    stats: DataFrame, methods: Sequence[str] = ("net", "conservative"), keys: Sequence[str] = ("symbol",),
    timeframe: str = "1m",
) -> DataFrame:
    """Summary, timing and flags per (series, method) from one pass over the trades."""
    per_method = [
        F.struct(
            F.lit(m).alias("method"),
            F.col(f"return_{m}").alias("return_m"),
            F.col(f"max_intra_drawdown_{m}").alias("max_intra_drawdown_m"),
            F.col(f"d5_{m}").alias("d5_m"),
            F.col(f"d5_to_exit_{m}").alias("d5_to_exit_m"),
        )
        for m in methods
    ]
    long = stats.select(*keys, "duration", F.inline(F.array(*per_method)))
    cols = _summary_columns(F.col("return_m"), F.col("max_intra_drawdown_m"), F.lit(None).cast("double"))
    cols |= _timing_columns("m")
    few = series_row_bound(timeframe) // 2 <= BUFFER_ROWS
    if few:
        cols["median_return"] = F.percentile("return_m", 0.5)
    table = long.groupBy(*keys, "method").agg(*[c.alias(n) for n, c in cols.items()])
    if not few:
        medians = exact_quantiles(long, [*keys, "method"], "return_m", {"median_return": 0.5})
        table = table.join(medians, [*keys, "method"])
    return with_quality_flags(table, keys)


def trade_paths(backtest: DataFrame, lane: Lane) -> DataFrame:
    """Long cumulative-return paths: bar 0 is the entry at 0.0, bar k the return of k bars."""
    bars = trade_bars(backtest, lane, ("net", "conservative"))
    label = F.concat("symbol", F.lit(" T"), F.col("trade_no").cast("string"))
    here = F.struct(
        F.col("bar_no").alias("bar_no"),
        (F.col("_growth_net") - 1).alias("cum_net"),
        (F.col("_growth_conservative") - 1).alias("cum_con"),
    )
    start = F.struct(F.lit(0).cast("long").alias("bar_no"), F.lit(0.0).alias("cum_net"), F.lit(0.0).alias("cum_con"))
    points = F.array_compact(F.array(F.when(F.col("bar_no") == 1, start), here))
    return bars.select(*lane.keys, label.alias("label"), F.inline(points))


def path_envelope(paths: DataFrame, keys: Sequence[str] = ("symbol",), value: str = "cum_net") -> DataFrame:
    """Mean, median and population deviation per bar number over the trades still open."""
    group = [*keys, "bar_no"]
    moments = paths.groupBy(*group).agg(
        F.count(value).alias("n_open"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    return moments.join(exact_quantiles(paths, group, value, {"median": 0.5}), group)
