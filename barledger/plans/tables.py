"""Domain tables (bars, book, FX, targets, deposits) that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barledger.sources.bars import resample

STATEMENT_DATE = "2000-06-30"
TARGET_FROM, TARGET_TO = "2000-07-01", "2001-01-01"
VALUATION_DATE = "2001-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_price():
    return F.lit(1000.0) + F.col("o_totalprice") / 10000.0


def bars_from_orders(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    return resample(
        table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"),
        _order_price(), F.col("o_orderkey"), timeframe,
    )


def bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(spark, sf_dir, "1d")


def bars_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(spark, sf_dir, "1w")


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(spark, sf_dir, "1h")


def bars_from_events(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """Ticks of one bar are ordered by time, then id; both fit one decimal sort key."""
    sequence = (
        F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)")
        * F.lit(10**12).cast("decimal(13,0)") + F.col("event_id")
    ).cast("decimal(38,0)")
    return resample(
        table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"),
        F.lit(100.0) + F.col("value") / 100.0, sequence, timeframe,
    )


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Order, line, part and cents as one decimal: unlike a struct it keeps the aggregate hash-based.
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    tie = F.col("l_partkey") * F.lit(10**9) + F.round(F.col("l_extendedprice") * 100).cast("long")
    sequence = (
        line.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + tie.cast("decimal(19,0)")
    ).cast("decimal(38,0)")
    return resample(
        table(spark, sf_dir, "lineitem"), F.col("l_suppkey").cast("string"), F.col("l_shipdate"),
        F.lit(1000.0) + F.col("l_extendedprice") / 10000.0, sequence, "1d",
    )


def orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their region. The geography is joined to customers first; whether a side is
    broadcast is left to its measured size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    buyers = customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", "r_name")
    orders = table(spark, sf_dir, "orders")
    return orders.join(buyers, orders.o_custkey == buyers.c_custkey)


def _weights(values: DataFrame) -> DataFrame:
    total = values.groupBy("name").agg(F.sum("value").alias("_total"))
    return values.join(total, "name").withColumn("weight", F.col("value") / F.col("_total")).drop("_total")


def holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = orders_by_region(spark, sf_dir).where(F.col("o_orderdate") < F.lit(TARGET_FROM).cast("timestamp_ntz"))
    values = past.groupBy(F.col("r_name").alias("name"), F.col("o_orderpriority").alias("ticker")).agg(
        F.sum("o_totalprice").alias("value")
    )
    return _weights(values).select(F.lit("current").alias("book_id"), "name", "ticker", "weight", "value")


def portfolio(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """One portfolio per region; the ordinal is its alphabetical rank (region keys follow it)."""
    totals = (held if held is not None else holding(spark, sf_dir)).groupBy("book_id", "name").agg(F.sum("value").alias("total_value"))
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    extra = (
        F.when(F.col("name") == "EUROPE", "managed_benchmark").when(F.col("name") == "ASIA", "protected").otherwise("custom")
    )
    usd = F.col("name").isin("AMERICA", "ASIA")
    return totals.join(region, "name").select(
        "book_id", "name", "ord",
        F.lit(STATEMENT_DATE).cast("date").alias("statement_date"),
        "total_value",
        F.when(usd, "USD").otherwise("SGD").alias("currency"),
        F.array(F.lit("holding"), extra).alias("roles"),
        F.when(F.col("name") == "EUROPE", 0.005).otherwise(0.0).alias("fee_annual"),
        F.when(usd, 1.3).alias("statement_fx"),
    )


# Asset classification of the five order priorities (fixed values).
UNIVERSE = (
    ("1-URGENT", "Equity", "US", "Technology"),
    ("2-HIGH", "Equity", "Japan", None),
    ("3-MEDIUM", "Bond", "US", "Treasury"),
    ("4-NOT SPECIFIED", "Commodity", "Global", "Gold"),
    ("5-LOW", "Cash", "Singapore", "Money Market"),
)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every ticker found in the orders."""
    tickers = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker")).distinct()

    def field(i: int):
        pairs = [x for row in UNIVERSE for x in (F.lit(row[0]), F.lit(row[i]).cast("string"))]
        return F.element_at(F.create_map(*pairs), F.col("ticker"))

    return tickers.select(
        "ticker", field(1).alias("asset_class"), field(2).alias("region"), field(3).alias("sector"),
    )


def target_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = orders_by_region(spark, sf_dir).where(
        (F.col("o_orderdate") >= F.lit(TARGET_FROM).cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit(TARGET_TO).cast("timestamp_ntz"))
    )
    values = recent.groupBy(F.col("r_name").alias("name"), F.col("o_orderpriority").alias("ticker")).agg(
        F.sum("o_totalprice").alias("value")
    )
    return _weights(values).select("name", F.lit(TARGET_TO).cast("date").alias("eff_date"), "ticker", "weight")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily USD to SGD rate."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.avg("l_discount").alias("d"))
    return daily.select("ts", (F.lit(1.30) + (F.col("d") - 0.05) / 10).alias("rate"))


def deposit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything paid in between the statement and the valuation."""
    at = orders_by_region(spark, sf_dir).where(
        (F.col("o_orderdate") >= F.lit(TARGET_FROM).cast("timestamp_ntz"))
        & (F.col("o_orderdate") <= F.lit(VALUATION_DATE).cast("timestamp_ntz"))
    )
    return at.groupBy(F.col("r_name").alias("name"), F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum("o_totalprice") / 100).alias("amount")
    ).select("name", "date", F.lit("SGD").alias("currency"), "amount", F.lit(None).cast("double").alias("fx_to_base"))
