"""Metrics over trailing windows and calendar years, for return series and for NAV curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.ordered import Lane, drop_borrowed, lay_out, running, unblock
from barledger.functions.stats import annual_vol, annualised, compound, sharpe
from barledger.schema import PERIODS_PER_YEAR

# Trailing windows in rows; None is the whole history (fixed values).
RETURN_WINDOWS = {"1M": 21, "3M": 63, "6M": 126, "1Y": 252, "All": None}
NAV_WINDOWS = {"1M": 30, "3M": 90, "6M": 180, "1Y": 365, "All": None}
MIN_RETURNS, MIN_NAVS = 5, 2
PARTIAL_DAYS = 7
PERIOD_COLUMNS = ("cum_return", "ann_return", "ann_vol", "sharpe", "max_dd")


def _period(label: Column, order: Column, kind: str) -> Column:
    return F.struct(label.alias("period"), order.cast("int").alias("period_ord"), F.lit(kind).alias("kind"))


def _memberships(series: DataFrame, keys: Sequence[str], windows: dict, extra: list[Column], timeframe: str, layout: dict) -> DataFrame:
    """One row per (row, period it belongs to). Only rows near the end join the short windows.

    The place from the end is the row count less the running count, so a long series is counted in
    blocks; the last year comes from the same aggregate as the count.
    """
    laid, lane = lay_out(series, keys, "ts", timeframe, **layout)
    counted = unblock(running(drop_borrowed(laid, lane), lane, {"_pos": ("sum", F.lit(1))}), lane)
    ends = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.year("ts")).alias("_last_year"))
    numbered = counted.join(ends, list(keys)).withColumn("_nth", F.col("_rows") - F.col("_pos") + 1)
    year = F.year("ts")
    periods = list(extra)
    for i, (label, rows) in enumerate(windows.items()):
        member = _period(F.lit(label), F.lit(10 + i), "window")
        periods.append(member if rows is None else F.when(F.col("_nth") <= rows, member))
    periods.append(_period(year.cast("string"), year, "year"))
    exploded = numbered.withColumn("_p", F.explode(F.array_compact(F.array(*periods))))
    return exploded.select("*", "_p.*").drop("_p", "_nth", "_pos", "_rows")


def _year_label() -> Column:
    """A calendar year that starts late, or the last one if it ends early, is partial."""
    year = F.col("period").try_cast("int")
    late = F.col("_from") > F.date_add(F.make_date(year, F.lit(1), F.lit(1)), PARTIAL_DAYS).cast("timestamp_ntz")
    early = F.col("_to") < F.date_sub(F.make_date(year, F.lit(12), F.lit(31)), PARTIAL_DAYS).cast("timestamp_ntz")
    partial = late | ((year == F.col("_last_year")) & early)
    return F.when(partial, F.concat("period", F.lit(" (partial)"))).otherwise(F.col("period"))


def _with_fall(members: DataFrame, lane: Lane) -> DataFrame:
    """Growth within a period and its fall from the highest growth so far; ``lane`` has the period as last key."""
    grown = running(members, lane, {"_growth": ("product", 1 + F.col("ret"))})
    peaked = running(grown, lane, {"_peak": ("max", F.col("_growth"))})
    return peaked.withColumn("_fall", F.col("_growth") / F.col("_peak") - 1)


def return_periods(
    returns: DataFrame, keys: Sequence[str], risk_free: float = 0.0, ppy: int = PERIODS_PER_YEAR, timeframe: str = "1m", **layout
) -> DataFrame:
    """Compound return and annualised statistics per period; fewer than five rows give NULLs."""
    present = returns.where(F.col("ret").isNotNull()).select(*keys, "ts", "ret")
    members = _memberships(present, keys, RETURN_WINDOWS, [], timeframe, layout)
    laid, lane = lay_out(members, [*keys, "period"], "ts", timeframe, **layout)
    members = _with_fall(drop_borrowed(laid, lane), lane)
    r, n = F.col("ret"), F.count("ret")
    total = compound(r)
    agg = members.groupBy(*keys, "period", "period_ord", "kind").agg(
        n.alias("days"),
        total.alias("cum_return"),
        annualised(total, n, ppy).alias("ann_return"),
        annual_vol(r, ppy).alias("ann_vol"),
        sharpe(F.avg(r), annual_vol(r, ppy), ppy, risk_free).alias("sharpe"),
        F.min("_fall").alias("max_dd"),
        F.min("ts").alias("_from"),
        F.max("ts").alias("_to"),
        F.max("_last_year").alias("_last_year"),
    )
    label = F.when(F.col("kind") == "year", _year_label()).otherwise(F.col("period"))
    enough = F.col("days") >= MIN_RETURNS
    return agg.select(
        *keys, label.alias("period"), "period_ord",
        *[F.when(enough, F.col(c)).alias(c) for c in PERIOD_COLUMNS], "days",
    )


def nav_periods(
    nav: DataFrame, keys: Sequence[str], risk_free: float = 0.0, ppy: int = PERIODS_PER_YEAR, timeframe: str = "1m", **layout
) -> DataFrame:
    """Start-to-end return of a NAV curve per period, and statistics of its changes inside it.

    Adds the periods since the statement (if ``statement_date`` is a column) and year to date.
    Window lengths are row counts.
    """
    extra = [F.when(F.year("ts") == F.col("_last_year"), _period(F.lit("YTD"), F.lit(1), "start"))]
    has_statement = "statement_date" in nav.columns
    if has_statement:
        since = F.col("ts") >= F.col("statement_date").cast("timestamp_ntz")
        extra.insert(0, F.when(since, _period(F.lit("Since stmt"), F.lit(0), "statement")))
    members = _memberships(nav.where(F.col("nav").isNotNull()), keys, NAV_WINDOWS, extra, timeframe, layout)
    laid, lane = lay_out(members, [*keys, "period"], "ts", timeframe, 1, 0, **layout)
    steps = laid.withColumn("ret", F.try_divide(F.col("nav"), F.lag("nav").over(lane.window())) - 1)
    steps = _with_fall(drop_borrowed(steps, lane), lane)
    r = F.col("ret")
    agg = steps.groupBy(*keys, "period", "period_ord", "kind").agg(
        F.count("nav").alias("days"),
        (F.max_by("nav", "ts") / F.min_by("nav", "ts") - 1).alias("cum_return"),
        F.when(F.count(r) > 0, annualised(compound(r), F.count(r), ppy)).alias("ann_return"),
        annual_vol(r, ppy).alias("ann_vol"),
        F.when(F.count(r) > 0, sharpe(F.avg(r), annual_vol(r, ppy), ppy, risk_free)).alias("sharpe"),
        F.min(F.when(r.isNotNull(), F.col("_fall"))).alias("max_dd"),
        F.min("ts").alias("_from"),
        F.max("ts").alias("_to"),
        F.max("_last_year").alias("_last_year"),
        *([F.max("statement_date").alias("_stmt")] if has_statement else []),
    )
    kind = F.col("kind")
    since_first = F.concat("period", F.lit(" (since "), F.col("_from").cast("date").cast("string"), F.lit(")"))
    label = F.when(kind == "year", _year_label())
    if has_statement:
        label = label.when(kind == "statement", F.concat(F.lit("Since stmt ("), F.col("_stmt").cast("string"), F.lit(")")))
    enough = F.col("days") >= MIN_NAVS
    return agg.where(enough | kind.isin("window", "year")).select(
        *keys, label.otherwise(since_first).alias("period"), "period_ord",
        *[F.when(enough, F.col(c)).alias(c) for c in PERIOD_COLUMNS], "days",
    )
