"""Holdings book from JSON documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from barledger.operators.book import WEIGHT_TOLERANCE
from barledger.sources.sheets import alias

BOOK_SCHEMA = (
    "statement_date string, currency string, portfolios array<struct<name: string, total_value: double, "
    "holdings: array<struct<ticker: string, legacy_id: string, weight: double, value: double>>>>"
)


def read_book(spark: SparkSession, path: str, legacy_key: str = "legacy_id",
              id_map: Mapping[str, str] | None = None, book_id: str = "current") -> tuple[DataFrame, DataFrame]:
    """(portfolio, holding) of the JSON documents under ``path``; malformed entries fail the job."""
    schema = BOOK_SCHEMA.replace("legacy_id", legacy_key)
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return parse_book(raw, legacy_key, id_map, book_id)


def parse_book(raw: DataFrame, legacy_key: str = "legacy_id", id_map: Mapping[str, str] | None = None,
               book_id: str = "current") -> tuple[DataFrame, DataFrame]:
    """Explode the documents; a missing key or a weight sum off one raises when the rows are read."""
    def needed(col, what: str):
        return F.coalesce(col, F.raise_error(F.lit(f"missing {what}")).cast("string"))

    entries = raw.select(
        needed(F.col("statement_date"), "statement_date").cast("date").alias("statement_date"),
        needed(F.col("currency"), "currency").alias("currency"), F.explode("portfolios").alias("p"),
    )
    weights = F.transform(F.col("p.holdings"), lambda h: h["weight"])
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    bad = F.raise_error(F.concat(F.lit("weights do not sum to one in "), F.col("p.name"))).cast("double")
    sums = F.abs(total - 1) <= WEIGHT_TOLERANCE
    portfolio = entries.select(
        F.lit(book_id).alias("book_id"), needed(F.col("p.name"), "name").alias("name"), "statement_date", "currency",
        F.when(sums, F.col("p.total_value")).otherwise(bad).alias("total_value"),
    )
    rows = entries.select(F.col("p.name").alias("name"), sums.alias("sums"), F.col("p.name").alias("of"), F.explode("p.holdings").alias("h"))
    unequal = F.raise_error(F.concat(F.lit("weights do not sum to one in "), F.col("of"))).cast("double")
    ticker = alias(F.coalesce(F.col("h.ticker"), F.col(f"h.{legacy_key}")), id_map)
    holding = rows.select(
        F.lit(book_id).alias("book_id"), "name", needed(ticker, "ticker").alias("ticker"), F.when(F.col("sums"), F.col("h.weight")).otherwise(unequal).alias("weight"),
        F.coalesce(F.col("h.value"), F.lit(0.0)).alias("value"),
    )
    return portfolio, holding


def anonymise(portfolio: DataFrame, holding: DataFrame, scale: float, names: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Scale every amount, round weights and rename portfolios."""
    renamed = alias(F.col("name"), names)
    return (
        portfolio.withColumns({"name": renamed, "total_value": F.round(F.col("total_value") * scale, 2)}),
        holding.withColumns({"name": renamed, "weight": F.round("weight", 6), "value": F.round(F.col("value") * scale, 2)}),
    )
