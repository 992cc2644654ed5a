"""Fund explorer: listing clean-up and multi-window metrics against the book."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from barledger.functions.listings import listing_ticker, wrapper_label
from barledger.functions.ordered import TAIL_SLICE_ROWS, newest_rows
from barledger.functions.stats import annual_vol, annualised, compound, sharpe
from barledger.schema import PERIODS_PER_YEAR

METRIC_WINDOWS = {"1Y": 252, "3Y": 756, "5Y": 1260}
# Window -> (rows, least common rows) of the correlation with the book; None rows is year to date.
CORR_WINDOWS = {"1M": (21, 10), "3M": (63, 20), "YTD": (None, 20), "1Y": (252, 20), "3Y": (756, 20), "5Y": (1260, 20)}


def fund_universe(sheet: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with a ticker code, its listing ticker and wrapper; known wrong codes are replaced."""
    rows = sheet.where(F.col("code").isNotNull()).withColumns({
        "ticker": listing_ticker(F.col("code"), F.col("name")), "wrapper": wrapper_label(F.col("code")),
    })
    if not overrides:
        return rows
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), F.trim("code"))
    return rows.withColumn("ticker", F.coalesce(fixed, "ticker"))


def fund_metrics(
    returns: DataFrame, risk_free: float = 0.0, ppy: int = PERIODS_PER_YEAR, timeframe: str = "1m", slice_rows: int = TAIL_SLICE_ROWS
) -> DataFrame:
    """One row per ticker: short cumulative returns, year to date, and figures per metric window.

    Figures over all rows are partially aggregated per ticker and year; the others look at the newest rows of
    a ticker only (``functions.ordered.newest_rows``), so no task holds a whole ticker.
    """
    present = returns.where(F.col("ret").isNotNull()).select("ticker", "ts", "ret")
    rows = newest_rows(present, ["ticker"], max(METRIC_WINDOWS.values()), timeframe, slice_rows=slice_rows)
    r = F.col("ret")
    # Growth is read back from the newest row, so each window needs only its own running product.
    for label, n in METRIC_WINDOWS.items():
        inside = F.when(F.col("_nth") <= n, 1 + r)
        upto = Window.partitionBy("ticker").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"_g{label}", F.when(F.col("_nth") <= n, F.product(inside).over(upto)))
        rows = rows.withColumn(f"_d{label}", F.col(f"_g{label}") / F.max(f"_g{label}").over(upto) - 1)
    n_all = F.count(r)  # a ticker with fewer rows than a window has them all in the tail

    def tail(n: int):
        return F.when(F.col("_nth") <= n, r)

    cols = [
        F.when(n_all >= 5, compound(tail(21))).alias("cum_return_1M"),
        F.when(n_all >= 20, compound(tail(63))).alias("cum_return_3M"),
    ]
    for label, n in METRIC_WINDOWS.items():
        x = tail(n)
        vol, count = annual_vol(x, ppy), F.count(x)
        enough = count >= 5
        cols += [
            F.when(enough, sharpe(F.avg(x), vol, ppy, risk_free)).alias(f"sharpe_{label}"),
            F.when(enough, annualised(compound(x), count, ppy)).alias(f"ann_return_{label}"),
            F.when(enough, F.min(f"_d{label}")).alias(f"max_dd_{label}"),
            F.when(enough, vol).alias(f"vol_{label}"),
        ]
    years = present.groupBy("ticker", F.year("ts").alias("_year")).agg(F.count(r).alias("_n"), compound(r).alias("_growth"))
    whole = years.groupBy("ticker").agg(F.sum("_n").alias("n_days"), F.max_by("_growth", "_year").alias("ytd_return"))
    return whole.join(rows.groupBy("ticker").agg(*cols), "ticker")


def book_correlations(returns: DataFrame, book: DataFrame, timeframe: str = "1m", slice_rows: int = TAIL_SLICE_ROWS) -> DataFrame:
    """Correlation of every ticker with the book return (``ts, book_ret``) over several windows."""
    both = returns.join(book.select("ts", "book_ret"), "ts").where("ret IS NOT NULL AND book_ret IS NOT NULL")
    both = both.select("ticker", "ts", "ret", "book_ret")
    tail = newest_rows(both, ["ticker"], max(n for n, _ in CORR_WINDOWS.values() if n), timeframe, slice_rows=slice_rows)
    cols = []
    for label, (n, least) in CORR_WINDOWS.items():
        if n is not None:
            a, b = F.when(F.col("_nth") <= n, F.col("ret")), F.when(F.col("_nth") <= n, F.col("book_ret"))
            cols.append(F.when(F.count(a) >= least, F.corr(a, b)).alias(f"corr_book_{label}"))
    least = CORR_WINDOWS["YTD"][1]
    years = both.groupBy("ticker", F.year("ts").alias("_year")).agg(
        F.count(F.lit(1)).alias("_n"), F.when(F.count(F.lit(1)) >= least, F.corr("ret", "book_ret")).alias("_corr"))
    newest = F.max_by(F.struct("_corr"), "_year")["_corr"]
    whole = years.groupBy("ticker").agg(F.sum("_n").alias("corr_n"), newest.alias("corr_book_YTD"))
    return whole.join(tail.groupBy("ticker").agg(*cols), "ticker")


def fund_explorer(universe: DataFrame, returns: DataFrame, book: DataFrame, timeframe: str = "1m") -> DataFrame:
    """Explorer table; a fund without data keeps its row."""
    figures, with_book = fund_metrics(returns, timeframe=timeframe), book_correlations(returns, book, timeframe)
    out = universe.join(figures, "ticker", "left").join(with_book, "ticker", "left")
    return out.withColumn("has_data", F.col("n_days").isNotNull()).fillna(0, ["n_days", "corr_n"])


def universe_audit(holding: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct holdings split into verified and new tickers."""
    known = universe.select("ticker").distinct().withColumn("_known", F.lit(True))
    rows = holding.select("name", "ticker").distinct().join(known, "ticker", "left")
    return rows.select("name", "ticker", F.when(F.col("_known"), "verified").otherwise("new").alias("status"))


def composition_drift(statement: DataFrame, target: DataFrame, band: float = 0.05) -> DataFrame:
    """Tickers whose weights differ by more than the band, or that only one side has."""
    on = ["name", "ticker"]
    a = statement.select(*on, F.col("weight").alias("statement_weight"))
    b = target.select(*on, F.col("weight").alias("target_weight"))
    both = a.join(b, on, "full_outer").withColumn("drift", F.col("target_weight") - F.col("statement_weight"))
    status = (
        F.when(F.col("target_weight").isNull(), "only in statement").when(F.col("statement_weight").isNull(), "only in target")
        .when(F.abs("drift") > band, "drift")
    )
    return both.withColumn("status", status).where("status IS NOT NULL")
