"""Bars from a provider of one's own: a small contract, read by Spark as a data source.

A provider says which symbols it has and yields the rows of one part of one symbol, or of parts that
hold many symbols; Spark plans a task per part, asks only for the symbols and the time span of the
query's filters, and applies every filter that a provider does not.
"""

from __future__ import annotations

import os
import uuid
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence, Set
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

from barledger.schema import BARS, PRICE_COLUMNS
from barledger.sources.bars import prefer_sources

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Subfolders of :func:`write_bars`.
BUCKETS = 128
ROWS = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us")), *[(c, pa.float64()) for c in PRICE_COLUMNS]])


class BarProvider(ABC):
    """Where bars come from. Instances travel to the tasks, so they hold settings, not connections."""

    @abstractmethod
    def symbols(self) -> Sequence[str]:
        """All symbols there are; called once per query, on the driver."""

    def parts(self, symbol: str) -> Sequence[str]:
        """Names of the pieces of a symbol that can be read on their own (files, years, pages); one task each."""
        return [""]

    @abstractmethod
    def read(self, symbol: str, part: str, start: datetime | None, end: datetime | None) -> Iterable[pa.Table | pa.RecordBatch]:
        """``ts`` and price columns of one part, in batches. Bars outside ``start`` to ``end`` (inclusive) may be left out."""


class PooledProvider(ABC):
    """A provider whose parts hold rows of many symbols, so that tasks go by bytes and not by symbols."""

    @abstractmethod
    def pools(self, symbols: Set[str] | None) -> Sequence[str]:
        """Names of the parts that may hold rows of ``symbols`` (None: of any); one task each. Called once per query, on the driver."""

    @abstractmethod
    def read_pool(
        self, pool: str, symbols: Set[str] | None, prefix: str, start: datetime | None, end: datetime | None
    ) -> Iterable[pa.Table | pa.RecordBatch]:
        """``symbol``, ``ts`` and price columns of one part. Rows of other symbols than ``symbols`` must, those without the
        ``prefix`` and outside ``start`` to ``end`` (inclusive) may be left out."""


class FolderProvider(PooledProvider):
    """A folder of Parquet bars that all machines see, as :func:`write_bars` leaves it: a subfolder ``bucket=...`` per bucket of symbols.

    One task per file. A query for some symbols opens the files of their buckets only; row groups outside its symbols and its
    time span are not read.
    """

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").removeprefix("file:")

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), os.path.abspath(self.folder))

    def pools(self, symbols: Set[str] | None) -> Sequence[str]:
        from pyarrow import fs

        store, base = self._store()
        wanted = None if symbols is None else {f"bucket={zlib.crc32(s.encode()) % BUCKETS}" for s in symbols}
        found = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            bucket = info.path[len(base):].strip("/").split("/")[0]
            if info.is_file and info.base_name.endswith(".parquet") and (wanted is None or bucket in wanted):
                found.append(info.path)
        return sorted(found)

    def read_pool(
        self, pool: str, symbols: Set[str] | None, prefix: str, start: datetime | None, end: datetime | None
    ) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        store, _ = self._store()
        kept = [] if symbols is None else [ds.field("symbol").isin(sorted(symbols))]
        kept += [pc.starts_with(ds.field("symbol"), prefix)] if prefix else []
        kept += [] if start is None else [ds.field("ts") >= pa.scalar(start, pa.timestamp("us"))]
        kept += [] if end is None else [ds.field("ts") <= pa.scalar(end, pa.timestamp("us"))]
        wanted = None
        for keep in kept:
            wanted = keep if wanted is None else wanted & keep
        yield from ds.dataset(pool, filesystem=store, format="parquet").to_batches(columns=ROWS.names, filter=wanted)


class _Part(InputPartition):
    def __init__(self, symbol: str | None, part: str):
        self.symbol, self.part = symbol, part


class _Reader(DataSourceReader):
    def __init__(self, provider: BarProvider | PooledProvider):
        self.provider, self.wanted, self.prefix, self.start, self.end = provider, None, "", None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = named if self.wanted is None else self.wanted & named
                continue
            if isinstance(f, StringStartsWith) and f.attribute == ("symbol",):
                self.prefix = max(self.prefix, f.value, key=len)
            if getattr(f, "attribute", None) == ("ts",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(filter(None, (self.start, f.value)))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = min(filter(None, (self.end, f.value)))
            yield f  # a prefix or a time span only narrows what is read; Spark has the last word

    def partitions(self) -> Sequence[InputPartition]:
        if isinstance(self.provider, PooledProvider):
            return [_Part(None, pool) for pool in self.provider.pools(self.wanted)]
        names = [s for s in self.provider.symbols() if (self.wanted is None or s in self.wanted) and s.startswith(self.prefix)]
        return [_Part(s, part) for s in names for part in self.provider.parts(s)]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partitions at all
            return
        if partition.symbol is None:
            found = self.provider.read_pool(partition.part, self.wanted, self.prefix, self.start, self.end)
        else:
            found = self.provider.read(partition.symbol, partition.part, self.start, self.end)
        for rows in found:
            table = pa.table(rows) if isinstance(rows, pa.RecordBatch) else rows
            symbol = table["symbol"] if partition.symbol is None else pa.repeat(pa.scalar(partition.symbol), table.num_rows)
            yield from pa.table([symbol, *[table[c] for c in ROWS.names[1:]]], names=ROWS.names).cast(ROWS).to_batches()


def load(spark: SparkSession, provider: BarProvider | PooledProvider) -> DataFrame:
    """Bars of a provider as a DataFrame with the columns of ``schema.BARS``; filters on ``symbol`` and ``ts`` reach the provider.

    Filter pushdown for such sources is switched on for the session unless it was set before.
    """
    if spark.conf.get(_PUSHDOWN, "false") != "true":
        spark.conf.set(_PUSHDOWN, "true")
    label = f"bars_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self):
            return BARS

        def reader(self, schema) -> DataSourceReader:
            return _Reader(provider)

    spark.dataSource.register(Source)
    return spark.read.format(label).load()


def load_first(spark: SparkSession, providers: Sequence[BarProvider | PooledProvider]) -> DataFrame:
    """Bars of every symbol from the first provider in the list that has any; ``priority`` tells which (the highest is the first)."""
    return prefer_sources([(len(providers) - i, load(spark, p)) for i, p in enumerate(providers)])


def write_bars(bars: DataFrame, folder: str, mode: str = "error") -> None:
    """Sink that :class:`FolderProvider` reads back: Parquet, a subfolder per bucket of symbols, sorted by symbol and time.

    The number of files follows the bytes: AQE splits a large bucket.
    """
    bucket = (F.crc32(F.col("symbol").cast("binary")) % BUCKETS).cast("int")
    dealt = bars.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "symbol", "ts")
    dealt.write.mode(mode).partitionBy("bucket").parquet(folder)
