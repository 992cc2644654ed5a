"""Exact linear-interpolated quantiles without gathering a group in one task.

Built-in ``percentile`` keeps every distinct value of a group in one aggregation buffer. That is
fine for a group bounded by the calendar (one series), not for trades pooled over all symbols.
Here an approximate sketch only chooses bucket borders; the answer is read from exact counts in
the one or two buckets that hold the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

_FINE = 32
_BUCKETS = _FINE * _FINE


# Up to this many rows a group's distinct values fit one aggregation buffer.
BUFFER_ROWS = 500_000


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], rows_bound: int
) -> DataFrame:
    """Quantiles of groups with a known row bound: built-in when it is small, else distributed."""
    if rows_bound > BUFFER_ROWS:
        return exact_quantiles(df, keys, value, probs)
    at = F.array(*[F.lit(float(p)) for p in probs.values()])
    found = df.groupBy(*keys).agg(F.percentile(value, at).alias("_q"))
    return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per key with a column per requested probability."""
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    steps = [i / _BUCKETS for i in range(1, _BUCKETS)]
    borders = present.groupBy(*keys).agg(
        F.percentile_approx("_v", steps, 10_000).alias("_cuts"), F.count("_v").alias("_n")
    ).withColumn("_coarse", F.expr(f"transform(sequence(1, {_FINE - 1}), i -> _cuts[i * {_FINE} - 1])"))
    # Equal values collapse before the shuffle, so a value shared by many rows costs one row.
    counts = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = counts.join(borders, keys).withColumn(
        "_hi", F.expr("size(filter(_coarse, c -> c < _v))")
    ).withColumn(
        "_bucket",
        F.expr(f"_hi * {_FINE} + size(filter(slice(_cuts, _hi * {_FINE} + 1, {_FINE}), c -> c < _v))"),
    ).drop("_cuts", "_coarse", "_hi")

    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_in"), F.first("_n").alias("_n"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_in").over(along), F.lit(0)))
    wanted = None
    ranks = {}
    for i, p in enumerate(probs.values()):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ranks[f"_{side}{i}"] = rank
            hit = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in"))
            wanted = hit if wanted is None else wanted | hit
    needed = totals.where(wanted).select(*keys, "_bucket", "_before")

    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(needed, [*keys, "_bucket"]).withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
    start = F.col("_end") - F.col("_c")
    picked = ranked.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *[
            F.max(F.when((rank >= start) & (rank < F.col("_end")), F.col("_v"))).alias(name)
            for name, rank in ranks.items()
        ],
    )
    out = []
    for i, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        share = at - F.floor(at)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * share).alias(name))
    return picked.select(*keys, *out)
