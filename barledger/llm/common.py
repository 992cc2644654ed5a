"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barledger.session import settle

#: A word is a run of characters that are not ASCII white space.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_mapper(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` body that handles every batch by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def sorted_groups(key_columns: list[str], fn: Callable[[dict[str, np.ndarray], np.ndarray], pa.RecordBatch | None]):
    """``mapInArrow`` body over partitions sorted by ``key_columns`` (integers without nulls).

    ``fn`` gets the columns of whole groups and the group borders (first row of every group, and the
    row count as last border). A group that runs over the end of a batch waits for the next batch,
    so one batch and one group are in memory, never the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, np.ndarray]] = []

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([k[c] for k in kept]) for c in kept[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            if kept and all(kept[0][c][0] == part[c][-1] for c in key_columns):
                kept.append(part)  # one group so far; joined once when it ends
                continue
            kept.append(part)
            cols = joined()
            borders = _borders(cols, key_columns)
            last = borders[-2]
            out = fn({c: v[:last] for c, v in cols.items()}, borders[:-1]) if last else None
            kept[:] = [{c: v[last:] for c, v in cols.items()}]
            if out is not None and out.num_rows:
                yield out
        if kept:
            cols = joined()
            out = fn(cols, _borders(cols, key_columns))
            if out is not None and out.num_rows:
                yield out

    return run


def _borders(cols: dict[str, np.ndarray], key_columns: list[str]) -> np.ndarray:
    n = len(cols[key_columns[0]])
    change = np.zeros(n, dtype=bool)
    for c in key_columns:
        change[1:] |= cols[c][1:] != cols[c][:-1]
    return np.concatenate(([0], np.flatnonzero(change), [n])).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the long columns ``a``, ``b``: one row ``node, root`` per node with an edge.

    Graph contraction: in each round every node hooks onto the neighbour of lowest hashed priority
    (or stays a root if its own is lower), edges move to the hooks, loops and repeats go. Priorities
    change from round to round, so long paths shrink by a constant share per round. All steps are
    keyed joins and partially aggregated minima; a hub of any degree arrives pre-aggregated. Rounds
    are cut by tables in the shared folder. ``root`` names the component and is one of its nodes.
    """
    ends = settle(_plain(edges.select("a", "b")))
    hooks: list[DataFrame] = []
    while not ends.isEmpty():
        seed = F.lit(len(hooks))
        both = ends.union(ends.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("id"))).alias("best"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("id"))
        hook = settle(best.select(F.col("a").alias("node"), F.least(F.col("best"), own)["id"].alias("root")))
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = ends.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        ends = settle(_plain(moved))
    if not hooks:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = hook.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found


def _plain(edges: DataFrame) -> DataFrame:
    pair = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.distinct()
