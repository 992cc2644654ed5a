"""Book model: roles, validation, exposure. Every operator is keyed by ``book_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

WEIGHT_TOLERANCE = 1e-4
CASH_PREFIX = "CASH_"
# Sectors treated as cash, lower case (fixed values).
CASH_SECTORS = ("money market", "treasury 0-3m")


def has_role(role: str) -> Column:
    return F.array_contains("roles", role)


def with_role(portfolio: DataFrame, role: str = "holding") -> DataFrame:
    return portfolio.where(has_role(role))


def is_cash_like() -> Column:
    sector = F.lower(F.coalesce("sector", F.lit("")))
    named = F.lit(False)
    for word in CASH_SECTORS:
        named = named | F.contains(sector, F.lit(word))
    return F.coalesce(F.lower("asset_class") == "cash", F.lit(False)) | named


def weight_report(holding: DataFrame, tolerance: float = WEIGHT_TOLERANCE) -> DataFrame:
    """Weight sum per portfolio and whether it is one."""
    sums = holding.groupBy("book_id", "name").agg(F.sum("weight").alias("weight_sum"))
    return sums.withColumn("valid", F.abs(F.col("weight_sum") - 1) <= tolerance)


def check_weights(holding: DataFrame, tolerance: float = WEIGHT_TOLERANCE) -> DataFrame:
    """``holding`` unchanged; the job fails on the first portfolio whose weights do not sum to one."""
    report = weight_report(holding, tolerance)
    text = F.concat(F.lit("weights of "), "name", F.lit(" sum to "), F.col("weight_sum").cast("string"))
    passed = report.withColumn("_ok", F.when(F.col("valid"), True).otherwise(F.raise_error(text).cast("boolean")))
    return holding.join(passed.where("_ok").select("book_id", "name"), ["book_id", "name"])


def unknown_assets(holding: DataFrame, universe: DataFrame) -> DataFrame:
    return holding.join(universe.select("ticker"), "ticker", "left_anti")


def tickers_in_use(holding: DataFrame, targets: DataFrame) -> DataFrame:
    """Every ticker that is held or targeted: what prices have to be read for."""
    return holding.select("ticker").union(targets.select("ticker")).distinct()


def normalise_weights(holding: DataFrame) -> DataFrame:
    """Weight = value over portfolio total; the rounding residue goes to the last holding."""
    total = holding.groupBy("book_id", "name").agg(F.sum("value").alias("_total"), F.max("ord").alias("_last"))
    shares = holding.join(total, ["book_id", "name"]).withColumn("weight", F.round(F.col("value") / F.col("_total"), 6))
    residue = shares.groupBy("book_id", "name").agg((1 - F.sum("weight")).alias("_residue"))
    fixed = F.when(F.col("ord") == F.col("_last"), F.col("weight") + F.col("_residue")).otherwise(F.col("weight"))
    return shares.join(residue, ["book_id", "name"]).withColumn("weight", fixed).drop("_total", "_last", "_residue")


def holdings_with_meta(portfolio: DataFrame, holding: DataFrame, universe: DataFrame) -> DataFrame:
    """Holdings with their portfolio and asset data. Join sides are broadcast by measured size."""
    book = portfolio.drop("weight")
    return holding.drop("value").join(book, ["book_id", "name"]).join(universe, "ticker")


def ranked(rows: DataFrame, keys: Sequence[str], by: str, tie: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``: 1 for the largest ``by`` within ``keys``. Reports are read in this order."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), *tie)
    return rows.withColumn("rank", F.row_number().over(order))


def exposure(portfolio: DataFrame, holding: DataFrame, universe: DataFrame) -> DataFrame:
    """Value and weight by asset class, region and sector over the holding portfolios.

    Values are summed in their own currency. One aggregation serves the three dimensions.
    """
    rows = holdings_with_meta(with_role(portfolio), holding, universe)

    def member(dim: str, bucket: Column) -> Column:
        return F.struct(F.lit(dim).alias("dimension"), bucket.alias("bucket"))

    members = F.array(
        member("asset_class", F.col("asset_class")),
        member("region", F.col("region")),
        member("sector", F.coalesce("sector", F.lit("Unspecified"))),
    )
    sums = (
        rows.select("book_id", (F.col("weight") * F.col("total_value")).alias("value"), F.inline(members))
        .groupBy("book_id", "dimension", "bucket").agg(F.sum("value").alias("value"))
    )
    total = sums.groupBy("book_id", "dimension").agg(F.sum("value").alias("_total"))
    return sums.join(total, ["book_id", "dimension"]).select(
        "book_id", "dimension", "bucket", "value", (F.col("value") / F.col("_total")).alias("weight")
    )


def book_fx(portfolio: DataFrame, fx: DataFrame | None = None) -> DataFrame:
    """USD rate per book: statement rate of the first portfolio that has one, else the last rate, else 1."""
    held = with_role(portfolio)
    stated = F.min_by("statement_fx", F.when(F.col("statement_fx").isNotNull(), F.col("ord")))
    rates = held.groupBy("book_id").agg(stated.alias("_stated"))
    if fx is None:
        return rates.select("book_id", F.coalesce("_stated", F.lit(1.0)).alias("fx_rate"))
    last = fx.agg(F.max_by("rate", "ts").alias("_last"))
    return rates.crossJoin(F.broadcast(last)).select("book_id", F.coalesce("_stated", "_last", F.lit(1.0)).alias("fx_rate"))


def to_base(value: Column, currency: Column, rate: Column) -> Column:
    """USD amounts times the rate; anything else passes through."""
    return F.when(F.upper(currency) == "USD", value * rate).otherwise(value)


def portfolio_values(portfolio: DataFrame, rates: DataFrame) -> DataFrame:
    """Holding portfolios with their value in base currency and share of the book."""
    held = with_role(portfolio).join(rates, "book_id")
    valued = held.withColumn("value_base", to_base(F.col("total_value"), F.col("currency"), F.col("fx_rate")))
    total = valued.groupBy("book_id").agg(F.sum("value_base").alias("aum"))
    return valued.join(total, "book_id").withColumn("book_weight", F.col("value_base") / F.col("aum"))

