"""Data behind distribution and weight charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barledger.operators.capital import with_group_total


def histogram(rows: DataFrame, keys: Sequence[str], value: str, bins: int = 80) -> DataFrame:
    """Equal-width bins between the extremes of each group, with count, density and normal density."""
    x = F.col(value)
    span = rows.groupBy(*keys).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"), F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd")
    )
    placed = rows.where(x.isNotNull()).join(span, list(keys)).withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    at = F.least(F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), F.col("_width"))), F.lit(0)), F.lit(bins - 1))
    counts = placed.groupBy(*keys, at.cast("int").alias("bin"), "_lo", "_width", "_n", "_mu", "_sd").agg(F.count(F.lit(1)).alias("n"))
    mid = F.col("_lo") + (F.col("bin") + 0.5) * F.col("_width")
    z = F.try_divide(mid - F.col("_mu"), F.col("_sd"))
    normal = F.try_divide(F.exp(-z * z / 2), F.col("_sd") * F.sqrt(2 * F.pi()))
    return counts.select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_from"), "n",
        F.try_divide(F.col("n"), F.col("_n") * F.col("_width")).alias("density"), normal.alias("normal_density"),
    )


def win_loss_histogram(stats: DataFrame, method: str = "net", bins: int = 8) -> DataFrame:
    """Trade returns per symbol, wins and losses binned apart; a zero return counts as a loss."""
    ret = F.col(f"return_{method}")
    rows = stats.select("symbol", F.when(ret > 0, "win").otherwise("loss").alias("side"), ret.alias("ret"))
    return histogram(rows, ["symbol", "side"], "ret", bins)


def top_weights(weights: DataFrame, keys: Sequence[str] = (), n: int = 15) -> DataFrame:
    """Weights of the ``n`` symbols with the largest mean weight; missing values are 0.

    The mean runs over the timestamps on which the symbol has a weight.
    """
    means = weights.groupBy(*keys, "symbol").agg(F.avg("weight").alias("_mean"))
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_mean").desc(), "symbol"))
        chosen = means.withColumn("_n", place).where(F.col("_n") <= n).select(*keys, "symbol")
    else:
        chosen = means.orderBy(F.col("_mean").desc(), "symbol").limit(n).select("symbol")
    clock = with_group_total(weights.select(*keys, "ts").distinct(), chosen, list(keys))
    return clock.join(weights, [*keys, "ts", "symbol"], "left").fillna(0.0, ["weight"])
