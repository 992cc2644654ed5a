"""Registered queries: a Spark plan and, where SQL can say it, the same query for DuckDB.

Every query declares its output once (keys, integer and double columns). Both sides are cast and
rounded the same way; infinities become NULL so that hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barledger.plans import oracle_base

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, keys: str = "", ints: str = "", nums: str = "", digits: int = 6,
          ctes: str = "", sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``ctes`` names shared oracle tables."""
    key_cols, int_cols, num_cols = keys.split(), ints.split(), nums.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.select(
                *[F.col(c) for c in key_cols],
                *[F.col(c).cast("long").alias(c) for c in int_cols],
                *[_rounded(c, digits) for c in num_cols],
            )

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            cols = [*key_cols]
            cols += [f"CAST({c} AS BIGINT) AS {c}" for c in int_cols]
            cols += [
                f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN round(CAST({c} AS DOUBLE), {digits}) + 0.0 END AS {c}"
                for c in num_cols
            ]
            ORACLES[name] = oracle_base.with_tables(ctes.split(), f"SELECT {', '.join(cols)} FROM (\n{sql}\n) AS answer")
        return fn

    return wrap


def _rounded(name: str, digits: int):
    value = F.col(name).cast("double")
    finite = F.abs(value) < F.lit(float("inf"))
    return F.when(finite & ~F.isnan(value), F.round(value, digits) + 0.0).alias(name)
