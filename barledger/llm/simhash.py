"""SimHash near-duplicates: pigeonring chains as index keys, spanning links per key, contraction to components."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barledger.llm.common import WORD_BYTES, components, row_mapper, settle, sorted_groups, text_bytes

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Segments on the ring, low bits first. One more than MAX_BITS, so that one of them has no difference.
WIDTHS = (13, 13, 13, 13, 12)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit majority fingerprint of the XXH64 values of word shingles, repeats included."""
    words = WORD_BYTES.findall(data.lower())  # bytes.lower changes A-Z only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    count = n - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, count, 1 << 15):
        hi = min(count, lo + (1 << 15))
        hashes = np.fromiter((digest(line[s:e - 1], SEED) for s, e in zip(starts[lo:hi], ends[lo + shingle - 1:hi + shingle - 1])), np.uint64, hi - lo)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """``doc_id, fp`` of every row. Null texts and texts without a word have fingerprint 0."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t) for t in text_bytes(rows.column(1))), np.uint64, rows.num_rows)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    plain = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(row_mapper(batch), f"doc_id {id_type}, fp long")


def ring_masks(widths: tuple[int, ...] = WIDTHS) -> list[int]:
    """Bit mask of every segment."""
    low = [0, *accumulate(widths)]
    return [((1 << w) - 1) << lo for w, lo in zip(widths, low)]


def chain_keys(max_bits: int = MAX_BITS, widths: tuple[int, ...] = WIDTHS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start segment, mask) of the keys that find chains of two segments.

    Two fingerprints with at most ``max_bits`` differing bits over m segments have a start segment
    from which every chain of k segments has at most ``k * max_bits / m`` differences. With more
    segments than bits the first one is equal and the second differs in at most one bit: the first
    list compares both whole, the second leaves out one bit of the second segment each.
    """
    m, masks = len(widths), ring_masks(widths)
    if m <= max_bits or 2 * max_bits >= 2 * m:
        raise ValueError("more segments than differing bits are needed")
    same, one_off = [], []
    for i in range(m):
        second = masks[(i + 1) % m]
        same.append((i, masks[i] | second))
        one_off += [(i, masks[i] | second & ~(1 << b)) for b in range(64) if second >> b & 1]
    return same, one_off


def chain_test(difference: np.ndarray, start: int, max_bits: int = MAX_BITS, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """Positions in ``difference`` (xor of fingerprints) within budget: chains of 2, 3, ... segments, then all bits."""
    m, masks = len(widths), ring_masks(widths)
    left = np.arange(len(difference))
    mask = masks[start]
    for k in range(2, m + 1):
        mask |= masks[(start + k - 1) % m]
        left = left[np.bitwise_count(difference[left] & np.uint64(mask)) <= k * max_bits // m]
        if not len(left):
            break
    return left


def spanning_links(fps: np.ndarray, labels: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links between labels that join all linked fingerprints of one key; rows of one label are joined already.

    Breadth first: each reached row is compared with the rows not reached yet, so a dense group costs
    about one comparison per row and yields one link per label instead of all pairs.
    """
    links = []
    rest = np.arange(len(fps))
    while len(rest):
        mine = labels[rest] == labels[rest[0]]
        queue, rest = list(rest[mine]), rest[~mine]
        while queue and len(rest):
            q = queue.pop()
            hits = chain_test(fps[rest] ^ fps[q], start)
            if not len(hits):
                continue
            reached = np.unique(labels[rest[hits]])
            links += [(labels[q], r) for r in reached]
            joins = np.isin(labels[rest], reached)
            queue += list(rest[joins])
            rest = rest[~joins]
    return links


def key_links(rows: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """``a, b`` links between the labels of ``rows`` (``fp``, ``label``) found through ``keys``."""
    starts = [s for s, _ in keys]
    signed = [m - (1 << 64) if m >> 63 else m for _, m in keys]

    def groups(cols: dict[str, np.ndarray], borders: np.ndarray) -> pa.RecordBatch | None:
        sizes = np.diff(borders)
        links: list[tuple[int, int]] = []
        fps, labels, tags = cols["fp"].view(np.uint64), cols["label"], cols["tag"]
        for g in np.flatnonzero(sizes > 1):
            lo, hi = borders[g], borders[g + 1]
            links += spanning_links(fps[lo:hi], labels[lo:hi], starts[tags[lo]])
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    keyed = rows.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("tag", "part"), "fp", "label")
    placed = keyed.repartition("tag", "part").sortWithinPartitions("tag", "part", "fp")
    return placed.mapInArrow(sorted_groups(["tag", "part"], groups), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``, repeated rows and null ids included.

    Rows with one fingerprint collapse before the search, so copies cost one row per key. The search
    has two steps: keys that compare two whole segments join most of a group, keys that leave out a
    bit then compare only across the groups found. Nothing is capped: every pair within ``MAX_BITS``
    meets in a key, and linked fingerprints end in one component. ``component_id`` is the smallest
    non-null id of the component (null if it has none). An empty table gives no rows.
    """
    marked = settle(fingerprints(docs, id_col, text_col, id_type))
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    same, one_off = chain_keys()
    first = components(key_links(classes.select("fp", F.col("fp").alias("label")), same))
    labelled = settle(_relabel(classes, first, "fp"))
    second = components(key_links(labelled.select("fp", "label"), one_off))
    ends = settle(_relabel(labelled.select("fp", "first_id", F.col("label").alias("old")), second, "old"))
    smallest = ends.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = ends.join(smallest, "label").select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def _relabel(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``label``: root of ``key``, or ``key`` itself where it has no link."""
    by_key = roots.withColumnsRenamed({"node": key, "root": "label"})
    return rows.join(by_key, key, "left").withColumn("label", F.coalesce("label", key))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, one per component: that of the smallest ``doc_id``, with all its columns.

    A row without id stands behind all rows with one (its text's hash takes the place of the id). Of
    rows with one id in a component the first by the hash of its columns stays, of equal rows one; rows with one id and
    different texts may be in different components, each of which keeps a row. Rows are numbered once;
    the search moves fingerprints and numbers, and the texts move once, to meet the numbers that stay.
    """
    numbered = settle(docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row")))
    stand_in = F.shiftrightunsigned(F.xxhash64("whole.text"), 2) + F.lit(1 << 62)
    place = F.struct(F.coalesce(F.col("whole.doc_id").cast("long"), stand_in).alias("id"), F.xxhash64("whole").alias("hash"), "row")
    marked = near_duplicates(numbered.select(place.alias("key"), F.col("whole.text").alias("text")), "key", "text", "struct<id:long,hash:long,row:long>")
    first = marked.where("doc_id = component_id").select("doc_id.row")
    return numbered.join(first, "row", "left_semi").select("whole.*")
