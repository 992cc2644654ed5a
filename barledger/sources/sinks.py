"""Parquet sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write_frame(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write Parquet. With partition columns, rows are first gathered by them, so a folder gets few
    files; AQE splits a large one."""
    if partition_by:
        df = df.repartition(*partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def request_key(**parts) -> Column:
    """Stable id of a run from its named parts, values or columns; columns give each row the id of its own request."""
    body = F.to_json(F.struct(*[F.lit(parts[k]).alias(k) for k in sorted(parts)]))
    return F.sha2(body, 256)
