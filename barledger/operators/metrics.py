"""Performance metrics of return series, keyed: many series are one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.ordered import Lane, drop_borrowed, lay_out, rolling_product, running, series_row_bound, unblock
from barledger.functions.quantiles import group_quantiles
from barledger.functions.stats import (
    INF,
    annual_vol,
    annualised,
    compound,
    mean_where,
    positive_ratio,
    sample_kurtosis,
    sample_skewness,
    sharpe,
    sum_where,
)
from barledger.operators.capital import with_group_total
from barledger.schema import PERIODS_PER_YEAR

METRIC_COLUMNS = (
    "total_return", "ann_return", "ann_vol", "downside_vol", "sharpe", "sortino", "calmar", "omega",
    "max_drawdown", "avg_drawdown", "skewness", "kurtosis", "var_95", "cvar_95", "tail_ratio",
)


def drawdowns(returns: DataFrame, lane: Lane, ret: str = "ret") -> DataFrame:
    """Growth, its running peak and the fall from it. The first bar is its own peak, so a loss on
    the first bar does not show."""
    grown = running(returns, lane, {"growth": ("product", 1 + F.col(ret))})
    peaked = running(grown, lane, {"peak": ("max", F.col("growth"))})
    return peaked.withColumn("drawdown", F.try_divide(F.col("growth") - F.col("peak"), F.col("peak")))


def drawdown_series(returns: DataFrame, keys: Sequence[str], timeframe: str = "1m", **layout) -> tuple[DataFrame, Lane]:
    laid, lane = lay_out(returns.where(F.col("ret").isNotNull()), keys, "ts", timeframe, **layout)
    return drawdowns(drop_borrowed(laid, lane), lane), lane


def drawdown_columns(dd: Column) -> dict[str, Column]:
    return {"max_drawdown": F.min(dd), "avg_drawdown": mean_where(dd, dd < 0)}


def core_columns(r: Column, ppy: int = PERIODS_PER_YEAR, risk_free: float = 0.0) -> dict[str, Column]:
    """Return, risk and ratio statistics that need no second pass."""
    n, mean, vol = F.count(r), F.avg(r), annual_vol(r, ppy)
    negative = F.when(r < 0, r)
    down = F.when(F.count(negative) == 0, F.lit(0.0)).otherwise(annual_vol(negative, ppy))
    hurdle = risk_free / ppy
    gains, losses = sum_where(r - hurdle, r > hurdle), sum_where(hurdle - r, r < hurdle)
    total = compound(r)
    return {
        "n": n,
        "total_return": total,
        "ann_return": annualised(total, n, ppy),
        "ann_vol": vol,
        "downside_vol": down,
        "sharpe": sharpe(mean, vol, ppy, risk_free),
        "sortino": sharpe(mean, down, ppy, risk_free),
        "omega": F.when(losses > 0, gains / losses).otherwise(INF),
        "skewness": sample_skewness(r),
        "kurtosis": sample_kurtosis(r),
    }


def performance(
    returns: DataFrame,
    keys: Sequence[str],
    ppy: int = PERIODS_PER_YEAR,
    risk_free: float = 0.0,
    timeframe: str = "1m",
    **layout,
) -> DataFrame:
    """The full metric set, one row per series (``keys``, ``ts``, ``ret``)."""
    curve, lane = drawdown_series(returns, keys, timeframe, **layout)
    r = F.col("ret")
    tails = group_quantiles(returns, keys, "ret", {"_low": 0.05, "_high": 0.95}, series_row_bound(timeframe))
    with_tails = curve.join(tails, list(keys))
    low, high = F.col("_low"), F.col("_high")
    cols = core_columns(r, ppy, risk_free) | drawdown_columns(F.col("drawdown"))
    cols |= {
        "var_95": F.first(low),
        "cvar_95": F.avg(F.when(r <= low, r)),
        "_p95": F.first(high),
    }
    out = with_tails.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])
    depth, p05, p95 = F.abs("max_drawdown"), F.abs("var_95"), F.abs("_p95")
    return out.withColumns({
        "calmar": positive_ratio(F.col("ann_return"), depth, INF),
        "tail_ratio": positive_ratio(p95, p05, INF),
    }).drop("_p95")


def versus_benchmark(
    returns: DataFrame,
    benchmark: DataFrame,
    keys: Sequence[str],
    bench_keys: Sequence[str] = (),
    ppy: int = PERIODS_PER_YEAR,
    risk_free: float = 0.0,
) -> DataFrame:
    """Beta, alpha, information ratio and captures against ``benchmark`` (``ts``, ``bench``)."""
    on = [*bench_keys, "ts"]
    level = F.avg("bench").alias("_bench_mean")
    level = benchmark.groupBy(*bench_keys).agg(level) if bench_keys else benchmark.agg(level)
    r, b = F.col("ret"), F.col("bench")
    active = r - F.coalesce(b, F.lit(0.0))
    both = r.isNotNull() & b.isNotNull()
    aligned = returns.where(r.isNotNull()).join(benchmark, on, "left")
    up, down = b > 0, b < 0
    agg = aligned.groupBy(*keys).agg(
        positive_ratio(F.covar_samp(r, b), F.var_samp(F.when(both, b))).alias("beta"),
        compound(r).alias("_total"),
        F.count(r).alias("_n"),
        F.avg(active).alias("_active"),
        annual_vol(active, ppy).alias("_tracking"),
        F.try_divide(F.avg(F.when(up, r)), F.avg(F.when(up, b))).alias("up_capture"),
        F.try_divide(F.avg(F.when(down, r)), F.avg(F.when(down, b))).alias("down_capture"),
    )
    agg = with_group_total(agg, level, bench_keys)
    bench_ann = F.pow(1 + F.col("_bench_mean"), F.lit(float(ppy))) - 1
    own = annualised(F.col("_total"), F.col("_n"), ppy)
    return agg.select(
        *keys,
        "beta",
        (own - (risk_free + F.col("beta") * (bench_ann - risk_free))).alias("alpha"),
        positive_ratio(F.col("_active") * ppy, F.col("_tracking")).alias("information_ratio"),
        "up_capture",
        "down_capture",
    )


def longest_underwater(returns: DataFrame, keys: Sequence[str], timeframe: str = "1m", **layout) -> DataFrame:
    """Longest time from a fall to its recovery, in days; a fall still open does not count."""
    curve, lane = drawdown_series(returns, keys, timeframe, **layout)
    under = F.col("drawdown") < 0
    counted = running(curve, lane, {"_dry": ("sum", F.when(under, 0).otherwise(1))})
    # A recovery bar closes the stretch that follows the previous dry bar.
    stretch = F.when(under, F.col("_dry")).otherwise(F.col("_dry") - 1)
    spans = counted.groupBy(*keys, stretch.alias("_stretch")).agg(
        F.min(F.when(under, F.col("ts"))).alias("_from"),
        F.min(F.when(~under, F.col("ts"))).alias("_to"),
    )
    seconds = F.unix_seconds(F.col("_to").cast("timestamp")) - F.unix_seconds(F.col("_from").cast("timestamp"))
    return spans.groupBy(*keys).agg((F.max(seconds) / 86400.0).alias("underwater_days"))


def rolling_sharpe(
    returns: DataFrame, keys: Sequence[str], n: int = PERIODS_PER_YEAR, ppy: int = PERIODS_PER_YEAR,
    risk_free: float = 0.0, timeframe: str = "1m", **layout,
) -> DataFrame:
    """Sharpe ratio of the last ``n`` bars; NULL until full or without variance."""
    laid, lane = lay_out(returns, keys, "ts", timeframe, n, 0, **layout)
    frame = lane.back(n)
    full = F.count("ret").over(frame) == n
    spread = F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(float(ppy)))
    value = F.try_divide(F.avg("ret").over(frame) * ppy - risk_free, spread)
    out = laid.withColumn("rolling_sharpe", F.when(full, value))
    return drop_borrowed(out, lane).select(*keys, "ts", "rolling_sharpe")


def rolling_return(
    returns: DataFrame, keys: Sequence[str], n: int, timeframe: str = "1m", **layout
) -> DataFrame:
    """Compounded return of the last ``n`` bars."""
    laid, lane = lay_out(returns, keys, "ts", timeframe, n, 0, **layout)
    out = laid.withColumn("rolling_return", rolling_product(1 + F.col("ret"), lane, n) - 1)
    return drop_borrowed(out, lane).select(*keys, "ts", "rolling_return")


def monthly_returns(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compound return per calendar month; a month without bars inside the range is 0."""
    month = F.trunc(F.col("ts").cast("date"), "month")
    by_month = returns.where(F.col("ret").isNotNull()).groupBy(*keys, month.alias("month_start")).agg(
        compound(F.col("ret")).alias("ret")
    )
    span = by_month.groupBy(*keys).agg(F.min("month_start").alias("_a"), F.max("month_start").alias("_b"))
    spine = span.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias("month_start"))
    filled = spine.join(by_month, [*keys, "month_start"], "left").fillna(0.0, ["ret"])
    return filled.select(*keys, F.year("month_start").alias("year"), F.month("month_start").alias("month"), "ret")


def monthly_table(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Year by month, twelve fixed columns ``m1`` to ``m12``."""
    wide = monthly_returns(returns, keys).groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return wide.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def simple_returns(prices: DataFrame, lane: Lane, price: str = "close", log: bool = False) -> DataFrame:
    """Change against the previous row of the same series; a missing price voids two returns."""
    step = F.try_divide(F.col(price), F.lag(price).over(lane.window()))
    return prices.withColumn("ret", F.ln(step) if log else step - 1)


def panel_returns(prices: DataFrame, keys: Sequence[str] = ("symbol",), price: str = "close", log: bool = False,
                  timeframe: str = "1m", **layout) -> DataFrame:
    """Returns on the panel calendar: the step is taken against the previous timestamp of the whole
    panel, so a symbol without a price there has no return.

    The calendar (one row per timestamp) is numbered once and joined, instead of filling a wide matrix.
    """
    group = [k for k in keys if k != "symbol"]
    days = prices.select(*group, "ts").distinct()
    numbered, lane = lay_out(days if group else days.withColumn("_all", F.lit(0)), group or ["_all"], "ts", timeframe, 1, 0, **layout)
    before = numbered.withColumn("_prev_ts", F.lag("ts").over(lane.window()))
    calendar = drop_borrowed(before, lane).select(*group, "ts", "_prev_ts")
    laid, series = lay_out(prices.join(calendar, [*group, "ts"]), keys, "ts", timeframe, 1, 0, **layout)
    w = series.window()
    adjacent = F.lag("ts").over(w) == F.col("_prev_ts")
    step = F.when(adjacent, F.try_divide(F.col(price), F.lag(price).over(w)))
    stepped = laid.withColumn("ret", F.ln(step) if log else step - 1).drop("_prev_ts")
    return unblock(drop_borrowed(stepped, series), series)


def normalise_to(series: DataFrame, keys: Sequence[str], value: str, base: float) -> DataFrame:
    """Scale a curve so that its first value is ``base``."""
    first = series.groupBy(*keys).agg(F.min_by(value, "ts").alias("_first"))
    return series.join(first, list(keys)).withColumn(value, F.col(value) / F.col("_first") * base).drop("_first")


def nav_summary(nav: DataFrame, keys: Sequence[str], trades: DataFrame | None = None,
                risk_free: float = 0.0, ppy: int = PERIODS_PER_YEAR, timeframe: str = "1m", **layout) -> DataFrame:
    """Result-level summary of a NAV curve (``keys``, ``ts``, ``nav``)."""
    laid, lane = lay_out(nav, keys, "ts", timeframe, 1, 0, **layout)
    steps = running(drop_borrowed(simple_returns(laid, lane, "nav"), lane), lane, {"peak": ("max", F.col("nav"))})
    r, fall = F.col("ret"), F.col("nav") / F.col("peak") - 1
    total = F.max_by("nav", "ts") / F.min_by("nav", "ts") - 1
    out = steps.groupBy(*keys).agg(
        total.alias("total_return"),
        annualised(total, F.count("nav"), ppy).alias("ann_return"),
        annual_vol(r, ppy).alias("ann_vol"),
        sharpe(F.avg(r), annual_vol(r, ppy), ppy, risk_free).alias("sharpe"),
        F.min(fall).alias("max_drawdown"),
    )
    out = out.withColumn("calmar", positive_ratio(F.col("ann_return"), F.abs("max_drawdown"), INF))
    if trades is None:
        return out
    counts = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_trades"))
    return out.join(counts, list(keys), "left").fillna(0, ["num_trades"])


def describe(returns: DataFrame, keys: Sequence[str], col: str = "ret", timeframe: str = "1m") -> DataFrame:
    """Count, moments and quartiles of a returns panel."""
    moments = returns.groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    return moments.join(group_quantiles(returns, keys, col, quarters, series_row_bound(timeframe)), list(keys))
