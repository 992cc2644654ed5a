"""Shards of near-equal bytes by histogram sort: exact counts below candidate borders, refined until the splitters fit."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from barledger.llm.common import settle

SHARDS = 24
#: Digits of the sort key: text, id, row; and digits by which a round refines a border.
TEXT_DIGITS, ID_DIGITS, ROW_DIGITS = 16, 16, 16
KEY_DIGITS = TEXT_DIGITS + ID_DIGITS + ROW_DIGITS
FIRST_ROUND, ROUND = 3, 2
#: A splitter may miss its target by this part (one in ...) of a shard; beyond that it is refined, to single rows if need be.
TOLERANCE = 200
#: Rows that one task orders within a shard.
TASK_ROWS = 1 << 20
#: Digits beyond a candidate border that a round looks at to find out how many all keys share.
_AHEAD = 15
#: Sorts after every digit, so ``prefix + _AFTER`` lies behind all keys with that prefix.
_AFTER = "g"


@dataclass(frozen=True)
class Splitter:
    """A border between keys, with the exact size and number of rows below it."""

    key: str
    size: int
    rows: int


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def keyed(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Columns ``carry`` in a struct ``row``, with ``key``, ``size`` and ``text_crc32``, written once.

    Keys are hex digits of the text, of the id and of the row number, so equal texts are neighbours
    and even equal rows have an order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digits = lambda name, n: F.substring(F.md5(name), 1, n)
    row = F.lower(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), ROW_DIGITS, "0"))
    key = F.concat(digits(text, TEXT_DIGITS), digits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), ID_DIGITS), row)
    return settle(docs.select(F.struct(*carry).alias("row"), key.alias("key"), size_of(F.col("text").cast("string")).alias("size"), F.crc32(text).alias("text_crc32")))


def splitters(rows: DataFrame, targets: Sequence[tuple[int, int]], unit: str, slack: tuple[int, int]) -> list[Splitter]:
    """One splitter for every target: a sum of ``unit`` (``size`` or ``rows``) as a fraction (numerator, denominator), ascending.

    Every round counts exactly, in one partially aggregated pass over ``key`` and ``size``, what lies below
    the candidate borders: key prefixes, at first of all keys, then longer ones around the targets
    that no border meets within ``slack`` (a fraction too). A target between two borders takes the nearer one, the
    lower if equal. Digits that all keys of the open ranges share are passed over. The driver sees at
    most 16 ** ``ROUND`` counts per open target, and never a row.
    """
    found: dict[int, Splitter] = {}
    # node of a target: prefix, size and rows below it
    nodes = {i: ("", 0, 0) for i in range(len(targets))}
    depth = FIRST_ROUND
    while 16 ** depth < 16 * len(targets):
        depth += 1
    while nodes:
        last = max(len(p) for p, _, _ in nodes.values())
        wanted = sorted({p for p, _, _ in nodes.values()})
        scan = rows if last == 0 else rows.where(F.substring("key", 1, last).isin(wanted))
        ahead = F.conv(F.substring("key", depth + 1, _AHEAD), 16, 10).cast("long")
        counts = scan.groupBy(F.substring("key", 1, depth).alias("p")).agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(ahead).alias("least"), F.max(ahead).alias("most")).collect()
        children: dict[str, list] = {}
        for r in sorted(counts, key=lambda r: r.p):
            children.setdefault(r.p[:last], []).append(r)
        ends: dict[str, list[int]] = {p: list(accumulate(r[unit] for r in own)) for p, own in children.items()}
        sums = {p: (list(accumulate((r.size for r in own), initial=0)), list(accumulate((r["rows"] for r in own), initial=0))) for p, own in children.items()}
        open_nodes = {}
        for i, (prefix, size, below) in nodes.items():
            top, bottom = targets[i]
            base = size if unit == "size" else below
            own = children[prefix]
            at = min(bisect_left(ends[prefix], top - bottom * base, key=lambda x: x * bottom), len(own) - 1)
            sizes, numbers = sums[prefix]
            lower = Splitter(own[at].p, size + sizes[at], below + numbers[at])
            upper = Splitter(own[at].p + _AFTER, size + sizes[at + 1], below + numbers[at + 1])
            value = lambda s: s.size if unit == "size" else s.rows
            short, over = top - bottom * value(lower), bottom * value(upper) - top
            best, miss = (lower, short) if short <= over else (upper, over)
            fits = abs(miss) * slack[1] <= slack[0] * bottom
            if fits or own[at]["rows"] == 1 or depth == KEY_DIGITS:
                found[i] = best
            else:
                open_nodes[i] = (own[at].p, lower.size, lower.rows, own[at].least, own[at].most)
        shared = min((_shared_digits(least, most, depth) for *_, least, most in open_nodes.values()), default=0)
        nodes = {i: node[:3] for i, node in open_nodes.items()}
        depth = min(depth + ROUND + shared // ROUND * ROUND, KEY_DIGITS)
    return [found[i] for i in range(len(targets))]


def _shared_digits(least: int | None, most: int | None, depth: int) -> int:
    """Digits after ``depth`` that the smallest and the largest key have in common."""
    width = min(_AHEAD, KEY_DIGITS - depth)
    a, b = (f"{x or 0:0{width}x}" for x in (least, most)) if width > 0 else ("", "")
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), width)


def borders_below(borders: Sequence[str], key: Column) -> Column:
    """Number of ``borders`` (ascending) up to ``key``: halving over a constant array."""
    if not borders:
        return F.lit(0)
    known = F.array(*[F.lit(b) for b in borders])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(borders).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(known, at + step - 1) <= key, step).otherwise(0))


def assign(docs: DataFrame, carry: Sequence[str], shards: int = SHARDS, tolerance: int = TOLERANCE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Columns ``carry`` of every row with ``size, text_crc32, shard, slot``; bytes per shard are near equal.

    Histogram sort on (text digest, id digest, row): splitters at equal parts of all bytes, each
    within one ``tolerance``-th of a shard of its target, or else between the two rows around it.
    Copies of a text lie together and a splitter prefers their edge, so a group is cut only where
    keeping it would unbalance the shards. Shards of more than ``task_rows`` rows get further
    splitters by rows, so that a task orders a bounded part; ``slot`` is the place in the part plus
    the exact number of rows of the shard below it. One exchange moves the rows; before it only
    counts move.

    A null text is empty (size 8); null ids are ids of their own kind; equal rows get places of their
    own; a column of ``docs`` named as a result is replaced; an empty table gives no rows. Reruns agree but for which of
    several equal (id, text) rows has which place.
    """
    rows = keyed(docs, carry)
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    size, n = total["size"] or 0, total["n"]
    marks = splitters(rows, [(i * size, shards) for i in range(1, shards)], "size", (size, shards * tolerance)) if n else []
    starts = [0, *[m.rows for m in marks], n]
    inner = [(k, 1) for lo, hi in zip(starts, starts[1:]) for k in range(lo + task_rows, hi, task_rows)]
    cuts = splitters(rows, inner, "rows", (task_rows, 4)) if inner else []
    # a part belongs to the shard whose splitters lie below it
    borders = sorted([(m.key, m.rows, 1) for m in marks] + [(c.key, c.rows, 0) for c in cuts])
    shard_of = list(accumulate((b[2] for b in borders), initial=0))
    offset = [at - starts[s] for at, s in zip([0, *[b[1] for b in borders]], shard_of)]
    part = borders_below([b[0] for b in borders], F.col("key"))
    look = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("part"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    placed = rows.withColumn("part", part).withColumn("nth", nth)
    fresh = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "shard": look(shard_of).cast("int"), "slot": (look(offset) + F.col("nth") - 1).cast("long")}
    kept = [F.col("row").getField(c).alias(c) for c in carry if c not in fresh]
    return placed.select(*kept, *[v.alias(k) for k, v in fresh.items()])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of ``docs`` as Parquet, one folder a shard, rows of a file in the order of ``slot``."""
    assign(docs, docs.columns, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
