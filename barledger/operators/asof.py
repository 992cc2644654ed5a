"""As-of lookups: the last known value at or before a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.functions.ordered import drop_borrowed, lay_out, running


def as_of(
    probes: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    quote_time: str = "ts",
    timeframe: str = "1m",
    **layout,
) -> DataFrame:
    """Probes with ``out`` (last ``value`` at or before ``at``) and ``out_ts`` (when it was quoted).

    Distinct probe points and quotes are merged into one ordered series per key and filled forward,
    then joined back by equality: no range join, no row per (probe, quote) pair. A probe sits one
    microsecond after its instant, so that a quote at the same instant counts.
    """
    moment = F.col(at).cast("timestamp_ntz")
    quoted = quotes.where(F.col(value).isNotNull()).select(
        *keys,
        F.col(quote_time).cast("timestamp_ntz").alias("_t"),
        F.struct(F.col(value).alias("v"), F.col(quote_time).cast("timestamp_ntz").alias("t")).alias("_quote"),
        F.lit(None).cast("timestamp_ntz").alias("_probe"),
    )
    points = probes.select(*keys, moment.alias("_probe")).where(F.col("_probe").isNotNull()).distinct()
    asked = points.select(
        *keys, (F.col("_probe") + F.expr("interval 1 microsecond")).alias("_t"),
        F.lit(None).cast(quoted.schema["_quote"].dataType).alias("_quote"), "_probe",
    )
    laid, lane = lay_out(quoted.unionByName(asked), keys, "_t", timeframe, **layout)
    filled = running(drop_borrowed(laid, lane), lane, {"_quote": ("last", F.col("_quote"))})
    found = filled.where(F.col("_probe").isNotNull()).select(
        *keys, F.col("_probe").alias("_moment"), F.col("_quote.v").alias(out), F.col("_quote.t").alias(f"{out}_ts")
    )
    return probes.withColumn("_moment", moment).join(found, [*keys, "_moment"], "left").drop("_moment")


def as_of_single(probes: DataFrame, quotes: DataFrame, at: str, value: str, out: str, **kw) -> DataFrame:
    """As-of lookup in one unkeyed series (a currency rate)."""
    one = F.lit(0)
    return as_of(probes.withColumn("_k", one), quotes.withColumn("_k", one), ["_k"], at, value, out, **kw).drop("_k")


def target_intervals(targets: DataFrame) -> DataFrame:
    """Snapshots as half-open validity intervals ``[eff_date, eff_to)`` with their weight sum."""
    dates = targets.groupBy("name", "eff_date").agg(F.sum("weight").alias("weight_sum"))
    following = F.lead("eff_date").over(Window.partitionBy("name").orderBy("eff_date"))
    return dates.withColumn("eff_to", following)


def effective_targets(portfolio: DataFrame, targets: DataFrame, at: Column) -> DataFrame:
    """Target weights in force at ``at`` for each portfolio (``book_id, name, eff_date, ticker, weight``)."""
    asked = portfolio.select("book_id", "name", at.cast("date").alias("_at"))
    spans = target_intervals(targets)
    valid = (F.col("_at") >= F.col("eff_date")) & (F.col("eff_to").isNull() | (F.col("_at") < F.col("eff_to")))
    current = asked.join(spans, "name").where(valid).select("book_id", "name", "eff_date")
    return current.join(targets, ["name", "eff_date"]).select("book_id", "name", "eff_date", "ticker", "weight")


def fill_to_calendar(series: DataFrame, calendar: DataFrame, keys: Sequence[str], value: str,
                     back_fill: bool = False, timeframe: str = "1m", **layout) -> DataFrame:
    """``value`` on every calendar row, filled forward from calendar rows only (then backward).

    ``calendar`` holds ``keys`` and ``ts``.
    """
    joined = calendar.join(series.select(*keys, "ts", value), [*keys, "ts"], "left")
    laid, lane = lay_out(joined, keys, "ts", timeframe, **layout)
    filled = running(drop_borrowed(laid, lane), lane, {value: ("last", F.col(value))})
    filled = filled.select(*keys, "ts", value)
    if not back_fill:
        return filled
    first = joined.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_first"))
    return filled.join(first, list(keys)).withColumn(value, F.coalesce(value, "_first")).drop("_first")
