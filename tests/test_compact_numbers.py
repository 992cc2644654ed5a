"""Short numbers are rounded by their binary value, as C and DuckDB do."""

from pyspark.sql import functions as F

from barledger.functions import listings


def test_rounding_of_ties_and_near_ties(spark):
    import random

    rng = random.Random(4)
    values = [0.5, 1.5, 2.5, 0.49999999999999994, 999.5, 999.7, 1250.0, 1150.0, 1350.0, 999_950.0, 999_949.99, 1_015_000.0, 1_005_000.0, 1_125_000.0, 1e9, 2.675e9, 0.0]
    values += [rng.choice([1, 1e3, 1e6, 1e9]) * rng.randint(0, 999_999) / 1000 for _ in range(3000)] + [rng.randint(100, 99_999) * 10.0 + 5 * rng.randint(0, 1) for _ in range(1000)]

    def plain(v, big, small):
        for unit, places, mark in ((1e9, big, "B"), (1e6, big, "M"), (1e3, small, "K")):
            if v >= unit:
                return f"{v / unit:.{places}f}{mark}"
        return f"{v:.0f}"

    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", listings.compact(F.col("v")).alias("c"), listings.compact(F.col("v"), precise=True).alias("p")).collect()
    assert [(r.c, r.p) for r in found] == [(plain(r.v, 2, 1), plain(r.v, 3, 2)) for r in found]
    odd = spark.createDataFrame([(-1250.0,), (1250.0,), (None,)], "v double").select(listings.compact(F.col("v"), signed=True).alias("c")).collect()
    assert [r.c for r in odd] == ["-1.2K", "+1.2K", "—"]
