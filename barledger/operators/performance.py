"""Book performance and comparison with managed benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barledger.functions.ordered import lay_out, running
from barledger.functions.stats import compound
from barledger.operators.book import has_role
from barledger.operators.metrics import performance
from barledger.operators.periods import nav_periods, return_periods
from barledger.operators.returns import SERIES, aligned_panel, book_returns
from barledger.session import settle
from barledger.sources.bars import between

COMBINED = "Combined book"
BASE = ("sharpe", "max_dd", "annualised_vol")


def series_metrics(returns: DataFrame, timeframe: str = "1m", risk_free: float = 0.0) -> DataFrame:
    """Totals, year to date and risk figures per (book, series)."""
    base = performance(returns, SERIES, risk_free=risk_free, timeframe=timeframe)
    last = returns.where(F.col("ret").isNotNull()).groupBy(*SERIES).agg(F.max(F.year("ts")).alias("_year"))
    ytd = returns.join(last, SERIES).where(F.year("ts") == F.col("_year")).groupBy(*SERIES).agg(
        compound(F.col("ret")).alias("ytd_return")
    )
    return base.join(ytd, SERIES).select(
        *SERIES, "total_return", "ann_return", "ytd_return", "sharpe",
        F.col("max_drawdown").alias("max_dd"), F.col("ann_vol").alias("annualised_vol"), F.col("n").alias("n_days"),
    )


def benchmark_comparison(
    panel: DataFrame, values: DataFrame, aligned: bool = True, timeframe: str = "1m", risk_free: float = 0.0,
    start=None, end=None,
) -> DataFrame:
    """One row per portfolio plus the combined book, from ``start`` to ``end`` inclusive. Aligned rows share one window."""
    panel = between(panel, start, end)
    book = book_returns(panel, values, aligned).withColumn("name", F.lit(COMBINED))
    series = (aligned_panel(panel) if aligned else panel).select(*SERIES, "ts", "ret")
    every = settle(series.unionByName(book.select(*SERIES, "ts", "ret")))
    table = series_metrics(every, timeframe, risk_free)
    worth = values.join(panel.select(*SERIES).distinct(), SERIES, "left_semi").select(*SERIES, F.col("value_base").alias("value"))
    total = worth.groupBy("book_id").agg(F.sum("value").alias("value")).select("book_id", F.lit(COMBINED).alias("name"), "value")
    return table.join(worth.unionByName(total), SERIES)


def benchmark_deltas(comparison: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Each row minus each managed benchmark of its book, long; pivot at the edge if wanted."""
    names = portfolio.where(has_role("managed_benchmark")).select(*SERIES)
    bench = comparison.join(names, SERIES, "left_semi").select(
        "book_id", F.col("name").alias("benchmark"), *[F.col(c).alias(f"_b_{c}") for c in BASE]
    )
    return comparison.join(bench, "book_id").select(
        *SERIES, "benchmark",
        (F.col("sharpe") - F.col("_b_sharpe")).alias("sharpe_delta"),
        (F.col("max_dd") - F.col("_b_max_dd")).alias("max_dd_delta"),
        (F.col("annualised_vol") - F.col("_b_annualised_vol")).alias("vol_delta"),
    )


def book_performance(
    panel: DataFrame, values: DataFrame, aligned: bool = True, timeframe: str = "1m", risk_free: float = 0.0
) -> DataFrame:
    """Assets under management and long-history metrics per book."""
    rets = book_returns(panel, values, aligned)
    figures = performance(rets, ["book_id"], risk_free=risk_free, timeframe=timeframe)
    aum = values.groupBy("book_id").agg(F.sum("value_base").alias("aum"), F.first("fx_rate").alias("fx_rate"))
    return aum.join(figures, "book_id", "left").select(
        "book_id", "aum", "fx_rate",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ann_return", "ann_vol", "sharpe")],
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_dd"), F.coalesce("n", F.lit(0)).alias("n_days"),
    )


def book_nav(book: DataFrame, timeframe: str = "1m", base: float = 100.0) -> DataFrame:
    """Book NAV starting from ``base`` before the first return."""
    laid, lane = lay_out(book, ["book_id"], "ts", timeframe)
    return running(laid, lane, {"nav": ("product", 1 + F.col("ret"))}).select(
        "book_id", "ts", (F.col("nav") * base).alias("nav")
    )


def book_periods(book: DataFrame, risk_free: float = 0.0, timeframe: str = "1m") -> DataFrame:
    return return_periods(book, ["book_id"], risk_free, timeframe=timeframe)


def book_windowed(since_nav: DataFrame, long_nav: DataFrame, aum: DataFrame, risk_free: float = 0.0, timeframe: str = "1m") -> DataFrame:
    """Period table with prices: the row since the statement from the buy-and-hold NAV, all others
    from the long history scaled to the assets under management.

    ``since_nav`` carries ``statement_date``; ``aum`` holds ``book_id, aum``.
    """
    first = nav_periods(since_nav, ["book_id"], risk_free, timeframe=timeframe).where(F.startswith("period", F.lit("Since stmt")))
    start = long_nav.groupBy("book_id").agg(F.min_by("nav", "ts").alias("_start"))
    scaled = long_nav.join(start, "book_id").join(aum, "book_id").select(
        "book_id", "ts", (F.col("nav") / F.col("_start") * F.col("aum")).alias("nav")
    )
    return first.unionByName(nav_periods(scaled, ["book_id"], risk_free, timeframe=timeframe))
