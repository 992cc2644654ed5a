"""Best-fit packing into sequences: token pieces, bin completion over their length counts, placement by rank."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barledger.llm.common import row_mapper, settle, texts

CAPACITY = 1024
END_ID = 2
#: Blocks that number the pieces of one length: a hot length is spread over them. At least so many, and
#: enough that a block has no more than about so many pieces even if all have one length.
LEAST_BLOCKS, BLOCK_ROWS = 256, 1 << 18
#: Steps of the search after its first descent.
SEARCH_STEPS = 4000
#: Branching per bin: choices tried in a place, and steps after which each place takes its first choice.
WIDTH, FILLING_STEPS = 16, 160
#: The rank file splits such texts as the vocabulary file does; other characters go to the latter.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*\Z")
_SPECIAL = "<|"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_paths() -> tuple[str, str]:
    """Vocabulary file and the rank file of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """text -> token ids of ``vocabulary``. With ``ranks`` (the same merges) the faster library does plain texts, with equal ids."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> list[int]:
        return fast.encode_ordinary(text) if _SPECIAL not in text and _PLAIN.match(text) else exact(text)

    return encode


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``capacity`` if there are several."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """Pieces of the token ids of every row (null text: empty), each document ended by ``END_ID``."""
    vocabulary, ranks = paths or default_paths()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary, ranks)
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(rows.column(0).to_pylist(), texts(rows.column(1))):
            ids = np.array([*encode(text), END_ID], dtype="<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start:start + length]))):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(row_mapper(batch), PIECES)


Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


def fillings(room: int, lengths: list[int], counts: dict[int, int]) -> Iterator[Filling]:
    """Undominated fillings of ``room`` from the lengths still there, least waste first, of any number of pieces.

    A filling is dominated if one of its pieces, or two together, could give way to a longer single
    piece that is there and still fits. An exact single piece dominates everything. The enumeration
    goes depth first from the longest pieces; after ``FILLING_STEPS`` steps it finishes what it has begun greedily
    and stops, and an exact filling stops it too.
    """
    fitting = [x for x in lengths if x <= room]  # longest first
    if not fitting:
        yield ()
        return
    if fitting[0] == room:
        yield ((room, 1),)
        return
    there = np.zeros(room + 1, dtype=bool)
    there[fitting] = True
    longest = np.maximum.accumulate(np.where(there, np.arange(room + 1), 0))  # longest piece up to a size
    found: dict[int, list[Filling]] = {}
    steps = 0

    def grow(chosen: Filling, left: int, cap: int) -> None:
        """Go on with the longest piece up to ``cap`` that fits, as often as it fits, then less often, then with shorter ones."""
        nonlocal steps
        steps += 1
        nxt, tries = int(longest[min(left, cap)]), 0
        while nxt and 0 not in found:
            for times in range(min(left // nxt, counts[nxt]), 0, -1):
                grow((*chosen, (nxt, times)), left - times * nxt, nxt - 1)
                tries += 1
                if tries >= WIDTH or steps >= FILLING_STEPS or 0 in found:
                    return  # what lies beyond the budget is left out; every filling found is complete
            nxt = int(longest[nxt - 1])
        if not tries and not spare(dict(chosen), left):
            found.setdefault(left, []).append(chosen)

    def spare(used: dict[int, int], left: int) -> bool:
        """Whether a piece that is not used up would still fit."""
        x = int(longest[left])
        while x and used.get(x, 0) == counts[x]:
            x = int(longest[x - 1])
        return x > 0

    grow((), room, room)
    least = min(found)
    leading = max(found[least])  # never left out, whatever the test says
    for waste in sorted(found):
        for pieces in sorted(set(found[waste]), reverse=True):
            own = [x for x, _ in pieces]
            pairs = [x + y for i, x in enumerate(own) for y in own[i + 1:]] + [2 * x for x, times in pieces if times > 1]
            if any(longest[min(room, x + waste)] > x for x in own) or any(longest[min(room, p + waste)] >= p for p in pairs):
                if waste != least or pieces != leading:
                    continue
            yield pieces


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and one for each piece over half."""
    volume = sum(x * n for x, n in counts.items())
    return max(-(-volume // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over length counts: (filling, bins that have it)."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                per = 1 if 2 * x > capacity else capacity // x
                bins, rest = divmod(left, per)
                for times, n in ((per, bins), (rest, 1)):
                    if times and n:
                        rooms.setdefault(capacity - times * x, []).append(({x: times}, n))
                break
            filled, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            per = min(room // x, left)
            used = min(n, left // per)
            rooms.setdefault(room - per * x, []).append(({**filled, x: filled.get(x, 0) + per}, used))
            if used < n:
                rooms.setdefault(room, []).append((filled, n - used))
            left -= per * used
    return [(tuple(sorted(f.items(), reverse=True)), n) for same in rooms.values() for f, n in same]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> list[tuple[Filling, int]]:
    """Packing of the given length counts: (filling, bins), by branch and bound.

    Each step completes the bin of the longest piece left with one undominated filling, as often as
    the counts allow. The best-fit packing is the first incumbent; a branch ends when the waste so
    far rules out fewer bins than the incumbent's. The search stops at the lower bound, or after
    ``steps`` steps beyond the first descent. The number of fillings depends on ``capacity`` alone.
    """
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    volume = sum(x * n for x, n in counts.items())
    floor = lower_bound(counts, capacity)
    if most <= floor:
        return best
    left = {x: n for x, n in counts.items() if n}
    path: list[tuple[Filling, int]] = []
    stack: list[Iterator[Filling]] = []
    wasted, budget = 0, steps

    def options() -> Iterator[Filling]:
        order = sorted(left, reverse=True)
        top = order[0]
        rest = dict(left)
        rest[top] -= 1
        for more in fillings(capacity - top, [x for x in order if rest[x]], rest):
            own = dict(more)
            own[top] = own.get(top, 0) + 1
            yield tuple(sorted(own.items(), reverse=True))

    def undo() -> None:
        nonlocal wasted
        filling, times = path.pop()
        wasted -= times * (capacity - sum(x * k for x, k in filling))
        for x, k in filling:
            left[x] = left.get(x, 0) + k * times

    descending = True
    stack.append(options())
    while stack and most > floor and (descending or budget > 0):
        budget -= not descending
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            if path:
                undo()
            continue
        times = min(left[x] // k for x, k in filling)
        waste = times * (capacity - sum(x * k for x, k in filling))
        if wasted + waste > (most - 1) * capacity - volume and not descending:
            continue
        path.append((filling, times))
        wasted += waste
        for x, k in filling:
            left[x] -= k * times
            if not left[x]:
                del left[x]
        if left:
            stack.append(options())
            continue
        descending = False
        bins = sum(n for _, n in path)
        if bins < most:
            best, most = list(path), bins
        undo()
    return best


def placement(plan: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Slots of the plan by length and rank: from which rank on, per bin, first bin, place of the first in its bin."""
    rows, used, base = [], {}, 0
    for filling, bins in plan:
        offset = 0
        for x, k in filling:
            rows.append((x, used.get(x, 0), k, base, offset))
            used[x] = used.get(x, 0) + k * bins
            offset += x * k
        base += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "per": table[:, 2], "bin": table[:, 3], "offset": table[:, 4]}


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """One row per piece of every row of ``docs``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    The texts are tokenised once. The packing is searched over how many pieces there are of each
    length (at most ``capacity`` numbers, all that reaches the driver), and its fillings, whose
    number depends on ``capacity`` alone, go back to the tasks. Pieces take their slots by their
    rank within their length; ranks are counted in blocks, so that no length is one task. Null text
    is an empty document (one token, its end); repeated rows are packed as often as they occur; an
    empty table gives no rows.
    """
    pieces = settle(token_pieces(docs, capacity, paths))
    blocks = max(LEAST_BLOCKS, -(-pieces.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")
    blocked = pieces.withColumn("block", block)
    sizes = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = placement(bin_completion(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = blocked.withColumn("nth", F.row_number().over(own) - 1).join(starts, ["length", "block"])
    numbered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).cast("long").alias("rank"))

    def place(rows: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = rows.column(3).to_numpy(), rows.column(5).to_numpy()
        slot = np.searchsorted(slots["key"], (length << 48) + rank, side="right") - 1
        bins, nth = np.divmod(rank - slots["rank"][slot], slots["per"][slot])
        put = [pa.array(slots["bin"][slot] + bins), pa.array(slots["offset"][slot] + nth * length)]
        return pa.RecordBatch.from_arrays([*rows.columns[:5], *put], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(row_mapper(place), f"{PIECES}, sequence_id long, offset long")
