"""Ordered computations over keyed series that stay parallel inside one long series.

A series (one symbol, one book, ...) is ordered by a timestamp. Two layouts exist:

* **whole** - one window partition per series. Chosen only when the bar width bounds the series:
  a daily series cannot hold more rows than there are days. See ``ROWS_PER_TASK``.
* **blocked** - a series is cut into consecutive blocks of about ``block_rows`` rows, one window
  partition each. Functions with finite reach (rolling mean, lag, lead) see rows borrowed from the
  neighbouring blocks; running functions are computed per block and joined with the carry of all
  earlier blocks. A minute series that holds a third of the table is then spread over many tasks.

Both layouts give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barledger.schema import TIMEFRAME_SECONDS
from barledger.session import settle

ROWS_PER_TASK = 4_000_000
HISTORY_SECONDS = 150 * 366 * 86400
BLOCK_ROWS = 1_000_000
SLICE_ROWS = 65_536
TAIL_SLICE_ROWS = 1_024

_BLK = "_blk"
_HALO = "_halo"
_SLICE = "_slice"


@dataclass(frozen=True)
class Lane:
    """How a series is laid out: grouping keys, order column, the block column if cut, and the bar width."""

    keys: tuple[str, ...]
    order: str = "ts"
    blocked: bool = False
    timeframe: str = "1m"

    @property
    def group_keys(self) -> tuple[str, ...]:
        """Keys that stay when symbols are combined (variant, book, ...)."""
        return tuple(k for k in self.keys if k != "symbol")

    def within(self, *extra: str) -> "Lane":
        """The same layout with a finer key, e.g. one trade of a symbol."""
        return replace(self, keys=self.keys + extra)

    def window(self) -> WindowSpec:
        parts = self.keys + ((_BLK,) if self.blocked else ())
        return Window.partitionBy(*parts).orderBy(self.order)

    def upto(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def back(self, n: int) -> WindowSpec:
        return self.window().rowsBetween(-(n - 1), 0)


def series_row_bound(timeframe: str) -> int:
    """Most rows one series can hold: one per bar slot over the longest supported history."""
    return HISTORY_SECONDS // TIMEFRAME_SECONDS[timeframe]


def lay_out(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    timeframe: str = "1m",
    reach_back: int = 0,
    reach_ahead: int = 0,
    block_rows: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> tuple[DataFrame, Lane]:
    """Choose a layout for ``df``, which must hold at most one row per series and bar slot.

    ``block_rows`` forces the blocked layout (tests use tiny blocks).
    """
    lane = Lane(tuple(keys), order, timeframe=timeframe)
    if block_rows is None:
        if series_row_bound(timeframe) <= ROWS_PER_TASK:
            return df, lane
        block_rows = BLOCK_ROWS
    if block_rows - slice_rows < max(reach_back, reach_ahead):
        raise ValueError("a block must be longer than one slice plus the reach of the functions")
    lane = replace(lane, blocked=True)
    span = TIMEFRAME_SECONDS[timeframe] * slice_rows
    epoch = F.unix_seconds(F.col(order).cast("timestamp"))
    sliced = df.withColumn(_SLICE, F.floor(epoch / F.lit(span)))
    slices = _assign_blocks(sliced, lane, block_rows, reach_back, reach_ahead)
    placed = sliced.join(slices, [*keys, _SLICE]).withColumn("_place", F.explode("_places"))
    return (
        placed.withColumn(_BLK, F.col("_place.blk"))
        .withColumn(_HALO, F.col("_place.halo"))
        .drop("_place", "_places", _SLICE)
    ), lane


def _assign_blocks(
    sliced: DataFrame, lane: Lane, block_rows: int, reach_back: int, reach_ahead: int
) -> DataFrame:
    """One row per (series, time slice): the block it belongs to and the blocks it lends rows to."""
    counts = sliced.groupBy(*lane.keys, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*lane.keys).orderBy(_SLICE)
    before = F.coalesce(
        F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    blocks = counts.withColumn(_BLK, F.floor(before / F.lit(block_rows)))
    inside = Window.partitionBy(*lane.keys, _BLK).orderBy(_SLICE)
    later = F.coalesce(F.sum("_n").over(inside.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    earlier = F.coalesce(
        F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )

    def place(blk: Column, halo: bool) -> Column:
        return F.struct(blk.alias("blk"), F.lit(halo).alias("halo"))

    places = F.array(
        place(F.col(_BLK), False),
        F.when(later < reach_back, place(F.col(_BLK) + 1, True)),
        F.when(earlier < reach_ahead, place(F.col(_BLK) - 1, True)),
    )
    return blocks.select(*lane.keys, _SLICE, F.array_compact(places).alias("_places"))


def drop_borrowed(df: DataFrame, lane: Lane) -> DataFrame:
    """Remove borrowed rows once every finite-reach function has been applied."""
    return df.where(~F.col(_HALO)).drop(_HALO) if lane.blocked else df


def unblock(df: DataFrame, lane: Lane) -> DataFrame:
    return df.drop(_BLK, _HALO) if lane.blocked else df


def newest_rows(df: DataFrame, keys: Sequence[str], n: int, timeframe: str = "1m", order: str = "ts", slice_rows: int = TAIL_SLICE_ROWS) -> DataFrame:
    """The newest ``n`` rows of every series, with their place ``_nth`` from the end (1 is the last row).

    Rows are counted per slice of time in a partially aggregated pass; only slices that hold some of
    the newest ``n`` rows are read on, so a window task orders at most ``n`` rows and a slice of one
    series, however long the series is. ``df`` holds at most one row per series and bar slot.
    """
    span = TIMEFRAME_SECONDS[timeframe] * slice_rows
    sliced = df.withColumn(_SLICE, F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(span)))
    newer = Window.partitionBy(*keys).orderBy(F.col(_SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    needed = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < n)
    tail = sliced.join(needed.select(*keys, _SLICE), [*keys, _SLICE], "left_semi").drop(_SLICE)
    from_end = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return tail.withColumn("_nth", F.row_number().over(from_end)).where(F.col("_nth") <= n)


_LOCAL = {
    "sum": lambda c: F.sum(c),
    "product": lambda c: F.product(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _merge(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry + local, carry, local)
    if op == "product":
        return F.coalesce(carry * local, carry, local)
    if op == "max":
        return F.greatest(carry, local)
    if op == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(df: DataFrame, lane: Lane, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running columns from series start to the current row.

    Operations: ``sum``, ``product``, ``max``, ``min``, ``last`` (last non-null), ``since``
    (rows since the condition last held, 0 on such a row; the row position if it never held) and
    ``affine``, whose value is a pair of columns (see ``_affine``).
    """
    maps = {n: pair for n, (op, pair) in specs.items() if op == "affine"}
    if maps:
        plain = {n: spec for n, spec in specs.items() if n not in maps}
        out = _affine(df, lane, maps)
        return running(out, lane, plain) if plain else out
    since = [n for n, (op, _) in specs.items() if op == "since"]
    upto = lane.upto()
    if lane.blocked:
        df = settle(df)
    if since:
        df = df.withColumn("_at", F.row_number().over(lane.window()).cast("long"))
        df = df.withColumns({f"_hit_{n}": F.when(specs[n][1], F.col("_at")) for n in since})
    values = {n: F.col(f"_hit_{n}") if op == "since" else col for n, (op, col) in specs.items()}
    local = {
        n: (F.max(values[n]) if op == "since" else _LOCAL[op](values[n])).over(upto)
        for n, (op, _) in specs.items()
    }
    if not lane.blocked:
        df = df.withColumns(local)
        if since:
            df = df.withColumns({n: F.col("_at") - F.coalesce(F.col(n), F.lit(0)) for n in since})
        return df.drop("_at", *[f"_hit_{n}" for n in since])

    df = df.withColumns({f"_loc_{n}": c for n, c in local.items()})
    out = df.join(_carries(df, lane, specs, values), [*lane.keys, _BLK])
    merged = {
        n: (
            F.when(F.col(f"_loc_{n}").isNotNull(), F.col("_at") - F.col(f"_loc_{n}"))
            .otherwise(F.col("_at") + F.col(f"_car_{n}"))
            if op == "since"
            else _merge(op, F.col(f"_car_{n}"), F.col(f"_loc_{n}"))
        )
        for n, (op, _) in specs.items()
    }
    helpers = [f"{p}_{n}" for n in specs for p in ("_loc", "_car")] + [f"_hit_{n}" for n in since]
    return out.withColumns(merged).drop("_at", *helpers)


def _affine(df: DataFrame, lane: Lane, maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Running composition of ``v -> factor * v + term``, applied to 0 before the first row.

    A row with factor 0 starts anew from its term, so the first row of a series gives its opening as
    a term. Between such rows the value is ``P * sum(term / P)`` with the running product ``P`` of the
    factors, two window functions instead of a fold. A block composes to one pair (product of its
    factors, value from 0); the pairs of earlier blocks compose the same way to the value carried in.
    Products must stay within the range of a double inside a block.
    """
    if not lane.blocked:
        for n, (factor, term) in maps.items():
            df = _affine_in(df, list(lane.keys), lane.order, factor, term, n)
        return df
    df = settle(df)
    for n, (factor, term) in maps.items():
        df = df.withColumn(f"_mul_{n}", F.product(factor).over(lane.upto()))
        df = _affine_in(df, [*lane.keys, _BLK], lane.order, factor, term, f"_loc_{n}")
    ends = [F.max_by(f"{part}_{n}", lane.order).alias(f"{part}_{n}") for n in maps for part in ("_mul", "_loc")]
    carried = df.groupBy(*lane.keys, _BLK).agg(*ends)
    before = Window.partitionBy(*lane.keys).orderBy(_BLK)
    for n in maps:
        carried = _affine_in(carried, list(lane.keys), _BLK, F.col(f"_mul_{n}"), F.col(f"_loc_{n}"), f"_end_{n}")
        carried = carried.withColumn(f"_car_{n}", F.coalesce(F.lag(f"_end_{n}").over(before), F.lit(0.0)))
    out = df.join(carried.select(*lane.keys, _BLK, *[f"_car_{n}" for n in maps]), [*lane.keys, _BLK])
    merged = {n: F.col(f"_loc_{n}") + F.col(f"_mul_{n}") * F.col(f"_car_{n}") for n in maps}
    return out.withColumns(merged).drop(*[f"{part}_{n}" for n in maps for part in ("_mul", "_loc", "_car")])


def _affine_in(df: DataFrame, parts: list[str], order: str, factor: Column, term: Column, name: str) -> DataFrame:
    start, scale = f"_start_{name}", f"_scale_{name}"
    upto = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy(*parts, start).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(start, F.sum(F.when(factor == 0, 1).otherwise(0)).over(upto))
    df = df.withColumn(scale, F.product(F.when(factor == 0, 1.0).otherwise(factor)).over(since))
    return df.withColumn(name, F.col(scale) * F.sum(term / F.col(scale)).over(since)).drop(start, scale)


def _carries(
    df: DataFrame, lane: Lane, specs: dict[str, tuple[str, Column]], values: dict[str, Column]
) -> DataFrame:
    """Per block, what all earlier blocks of the series contribute to each running column."""
    totals = [F.count(F.lit(1)).alias("_rows")]
    for n, (op, _) in specs.items():
        if op == "last":
            total = F.max_by(F.col(f"_loc_{n}"), F.col(lane.order))
        else:
            total = F.max(values[n]) if op == "since" else _LOCAL[op](values[n])
        totals.append(total.alias(f"_tot_{n}"))
    earlier = (
        Window.partitionBy(*lane.keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = df.groupBy(*lane.keys, _BLK).agg(*totals)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    carries = []
    for n, (op, _) in specs.items():
        if op == "since":
            hit = F.max(F.col("_offset") + F.col(f"_tot_{n}")).over(earlier)
            carry = F.col("_offset") - F.coalesce(hit, F.lit(0))
        else:
            carry = _LOCAL[op](F.col(f"_tot_{n}")).over(earlier)
        carries.append(carry.alias(f"_car_{n}"))
    return blocks.select(*lane.keys, _BLK, *carries)


def rolling_mean(col: Column, lane: Lane, n: int) -> Column:
    """Mean of the last ``n`` rows; NULL until all ``n`` are present."""
    frame = lane.back(n)
    return F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))


def rolling_product(col: Column, lane: Lane, n: int) -> Column:
    frame = lane.back(n)
    return F.when(F.count(col).over(frame) == n, F.product(col).over(frame))


def forward_fill(df: DataFrame, lane: Lane, *cols: str) -> DataFrame:
    return running(df, lane, {c: ("last", F.col(c)) for c in cols})
