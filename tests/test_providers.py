"""The provider contract: partitions, pushed filters, failover, round trip through the Parquet sink."""

import datetime as dt
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barledger.sources import providers
from helpers import DAY0, random_bars

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import a test module


class Made(providers.BarProvider):
    """Ten bars per symbol and year; reading a symbol outside ``allowed`` or a bar before ``since`` fails."""

    def __init__(self, names, allowed=None, since=None):
        self.names, self.allowed, self.since = names, allowed, since

    def symbols(self):
        return self.names

    def parts(self, symbol):
        return ["2020", "2021"]

    def read(self, symbol, part, start, end) -> Iterator[pa.RecordBatch]:
        assert self.allowed is None or symbol in self.allowed, symbol
        assert self.since is None or start == self.since
        ts = [dt.datetime(int(part), 1, 1) + dt.timedelta(days=i) for i in range(10)]
        price = [float(i) for i in range(10)]
        yield pa.RecordBatch.from_pydict({"volume": price, "ts": ts, "open": price, "high": price, "low": price, "close": price})


def test_all_parts_are_read(spark):
    bars = providers.load(spark, Made(["A", "B"]))
    assert bars.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert bars.rdd.getNumPartitions() == 4 and bars.count() == 40
    assert {(r.symbol, r.n) for r in bars.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {("A", 20), ("B", 20)}


def test_filters_reach_the_provider(spark):
    since = dt.datetime(2020, 1, 5)
    bars = providers.load(spark, Made(["A", "B", "C"], allowed={"B", "C"}, since=since))
    found = bars.where(F.col("symbol").isin("B", "C", "Z") & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("close") < 8))
    # the provider ignores the span; Spark still applies it
    assert found.groupBy("symbol").count().collect() and found.count() == 2 * (4 + 8)
    assert bars.where((F.col("symbol") == "B") & (F.col("ts") == F.lit(since).cast("timestamp_ntz"))).count() == 1
    assert providers.load(spark, Made([])).count() == 0


def test_first_provider_with_rows_wins(spark):
    both = providers.load_first(spark, [Made(["A"]), Made(["A", "B"])])
    assert {(r.symbol, r.priority, r.n) for r in both.groupBy("symbol", "priority").agg(F.count("*").alias("n")).collect()} == {("A", 2, 20), ("B", 1, 20)}


def test_round_trip_through_the_sink(spark, tmp_path):
    bars = random_bars(spark, symbols=("AAA", "B/B", "C C"), n=60)
    providers.write_bars(bars, f"file:{tmp_path}/bars")
    back = providers.load(spark, providers.FolderProvider(f"file:{tmp_path}/bars"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, bars.collect()))
    cut = F.lit(DAY0 + dt.timedelta(days=30)).cast("timestamp_ntz")
    for rows in (back, bars):
        assert rows.where((F.col("symbol") == "B/B") & (F.col("ts") > cut)).count() == bars.where((F.col("symbol") == "B/B") & (F.col("ts") > cut)).count() > 0


def test_tasks_do_not_grow_with_the_symbols(spark, tmp_path):
    names = [f"{i}" for i in range(1000)]
    bars = spark.createDataFrame([(s, DAY0 + dt.timedelta(days=d), 1.0, 2.0, 0.5, float(d), 1.0) for s in names for d in range(2)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    providers.write_bars(bars, f"file:{tmp_path}/bars")
    back = providers.load(spark, providers.FolderProvider(f"file:{tmp_path}/bars"))
    assert back.rdd.getNumPartitions() <= 2 * providers.BUCKETS < len(names)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, bars.collect()))
    assert back.where(F.col("symbol").startswith("1")).count() == 2 * 111 and back.where("symbol in ('7', '8', 'x')").count() == 4
    assert back.where("symbol = '7'").rdd.getNumPartitions() <= 2
