"""Near-duplicate vectors: random-projection tree forest with spill overlap, verified within leaves, united."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from barledger.llm.common import components, row_mapper, settle, sorted_groups

MIN_COSINE = 0.93
TREES = 12
#: Vectors in a leaf before overlap, on average over the largest label.
LEAF = 256
#: Overlap on either side of a split, in standard deviations of the projection.
SPILL = 0.1
#: Vectors that the split points are fitted on, chosen by hash.
SAMPLE = 20_000
#: Levels that have a split point per node; deeper ones share one per level.
FITTED_LEVELS = 12
#: Leaves over this size are compared in tiles.
TILE = 1000


@dataclass
class Forest:
    directions: np.ndarray  # trees x levels x dimensions
    points: np.ndarray  # trees x nodes in heap order, for the fitted levels
    medians: np.ndarray  # trees x levels
    margins: np.ndarray  # trees x levels


def fit(vectors: np.ndarray, depth: int, dimensions: int, trees: int = TREES, seed: int = 7) -> Forest:
    """Directions by chance, split points at the medians of the sample that reaches each node."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, dimensions))
    fitted = min(depth, FITTED_LEVELS)
    points, medians, margins = np.zeros((trees, 1 << fitted)), np.zeros((trees, depth)), np.zeros((trees, depth))
    for t in range(trees):
        node = np.ones(len(vectors), dtype=np.int64)
        for level in range(depth):
            along = vectors @ directions[t, level]
            medians[t, level] = np.median(along) if len(along) else 0.0
            margins[t, level] = SPILL * along.std() if len(along) else 0.0
            if level < fitted:
                points[t, 1 << level:2 << level] = medians[t, level]
                order = np.lexsort((along, node))
                borders = np.flatnonzero(np.diff(node[order])) + 1
                for part in np.split(order, borders):
                    if len(part) >= 8:
                        points[t, node[part[0]]] = np.median(along[part])
                cut = points[t, node]
            else:
                cut = medians[t, level]
            node = 2 * node + (along > cut)
    return Forest(directions, points, medians, margins)


def leaves(vectors: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf) of every leaf that a vector belongs to; near a split it goes both ways."""
    rows_out, trees_out, leaves_out = [], [], []
    depth = forest.directions.shape[1]
    fitted = forest.points.shape[1]
    for t in range(forest.directions.shape[0]):
        row, node = np.arange(len(vectors)), np.ones(len(vectors), dtype=np.int64)
        for level in range(depth):
            along = (vectors @ forest.directions[t, level])[row]
            cut = forest.points[t, node] if 1 << level < fitted else np.full(len(node), forest.medians[t, level])
            left, right = along <= cut + forest.margins[t, level], along > cut - forest.margins[t, level]
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        rows_out.append(row)
        trees_out.append(np.full(len(row), t))
        leaves_out.append(node)
    return np.concatenate(rows_out), np.concatenate(trees_out), np.concatenate(leaves_out)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Unit rows; shorter vectors are filled with zeros."""
    flat = np.zeros((len(column), dimensions))
    for i, v in enumerate(column.to_pylist()):
        flat[i, :len(v)] = v
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def classes_of(rows: DataFrame) -> DataFrame:
    """Distinct comparable vectors: ``cid, label, size, vector, copies, first_id``; copies collapse before the search."""
    grouped = rows.where("usable").groupBy("label", "h1", "h2").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    numbered = grouped.select("label", "h1", "h2", "vector", "copies", "first_id", F.size("vector").alias("size"))
    return settle(numbered.withColumn("cid", F.monotonically_increasing_id()))


def leaf_rows(classes: DataFrame, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``cid, label, size, place, earlier``: a row per tree and leaf of a class; ``earlier`` are its leaves before, in the order of trees and nodes."""
    largest = classes.groupBy("label", "size").count().agg(F.max("count"), F.max("size")).first()
    most, dimensions = int(largest[0] or 0), int(largest[1] or 1)
    depth = max(0, int(np.ceil(np.log2(max(most, 1) / leaf))))
    chosen = classes.where(F.col("size") == dimensions).select("vector").orderBy(F.xxhash64("vector"), "cid").limit(SAMPLE).toArrow()
    forest = fit(_matrix(chosen.column("vector").combine_chunks(), dimensions), depth, dimensions, trees)
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def assign(rows: pa.RecordBatch) -> pa.RecordBatch:
        row, tree, node = leaves(_matrix(rows.column(3), dimensions), shared.value)
        order = np.lexsort((node, tree, row))
        row, tree, node = row[order], tree[order], node[order]
        place = (tree << 48) + node
        first_of_row = np.searchsorted(row, row, side="left")
        lengths = np.arange(len(row)) - first_of_row
        ends = np.append(0, np.cumsum(lengths))
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first_of_row, lengths)
        earlier = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[at], pa.int64()))
        own = pa.array(row)
        return pa.RecordBatch.from_arrays([*[rows.column(i).take(own) for i in range(3)], pa.array(place), earlier], ["cid", "label", "size", "place", "earlier"])

    return classes.select("cid", "label", "size", "vector").mapInArrow(row_mapper(assign), "cid long, label long, size int, place long, earlier array<long>")


def leaf_links(classes: DataFrame, min_cosine: float = MIN_COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """What the leaves hold: rows ``a, n`` (``b`` null) add ``n`` linked vectors to class ``a``; rows ``a, b`` join two classes.

    A pair counts in the first leaf that both are in, so that sums over leaves are exact
    without listing pairs; the joins of a leaf are a spanning forest of its pairs. Both grow with the
    rows of a leaf, not with their square. Leaves over ``TILE`` rows are cut into parts, and every
    pair of parts is compared by a task of its own, so that no leaf is dropped, capped or read whole
    by one task.
    """
    placed = settle(leaf_rows(classes, trees, leaf))
    key = ["label", "size", "place"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / TILE).cast("long")
    own = F.pmod(F.xxhash64("cid"), F.col("parts"))
    counted = placed.join(counts, key).withColumn("parts", parts).withColumn("part", own)
    tiled = counted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tile = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    vectors = classes.select("cid", "copies", F.col("vector").cast(ArrayType(DoubleType())).alias("vector"))
    rows = tiled.withColumn("tile", tile).select("cid", *key, "tile", "part", "earlier").join(vectors, "cid")

    def compare(cols: dict[str, np.ndarray], borders: np.ndarray) -> pa.RecordBatch:
        a, b, n = [], [], []
        for lo, hi in zip(borders[:-1], borders[1:]):
            part, ids, copies = cols["part"][lo:hi], cols["cid"][lo:hi], cols["copies"][lo:hi]
            first, second = np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min())
            linked = _linked(np.stack(cols["vector"][lo:hi]), ids, cols["earlier"][lo:hi], first, second, min_cosine)
            near = np.flatnonzero(linked.any(axis=1))
            if not len(near):
                continue
            a += ids[near].tolist()
            b += [None] * len(near)
            n += (linked[near] @ copies).tolist()
            for x, y in _forest(linked[np.ix_(near, near)]):
                a.append(ids[near[x]])
                b.append(ids[near[y]])
                n.append(0)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    order = [*key, "tile"]
    dealt = rows.repartition(*order).sortWithinPartitions(*order, "cid")
    return dealt.mapInArrow(sorted_groups(order, compare), "a long, b long, n long")


def _linked(vectors: np.ndarray, ids: np.ndarray, earlier: np.ndarray, first: np.ndarray, second: np.ndarray, min_cosine: float) -> np.ndarray:
    """Rows x rows: pairs of the tile (``first`` with ``second``, or within ``first`` alone) that link and share no earlier leaf."""
    found = np.zeros((len(ids), len(ids)), dtype=bool)
    against = second if len(second) else first
    norms = np.linalg.norm(vectors, axis=1)
    close = vectors[first] @ vectors[against].T / (norms[first][:, None] * norms[against][None, :]) >= min_cosine
    close &= ids[first][:, None] != ids[against][None, :]
    if close.any():
        x, y = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        rows, columns = first[x], against[y]
        _, leaf = np.unique(np.concatenate([np.asarray(e) for e in earlier[[*rows, *columns]]] or [np.zeros(0)]), return_inverse=True)
        sizes = np.array([len(e) for e in earlier[[*rows, *columns]]])
        member = np.zeros((len(sizes), int(leaf.max()) + 1 if len(leaf) else 1), dtype=np.float32)
        member[np.repeat(np.arange(len(sizes)), sizes), leaf] = 1
        met = member[:len(rows)] @ member[len(rows):].T > 0
        found[np.ix_(rows, columns)] = close[np.ix_(x, y)] & ~met
        found |= found.T
    return found


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric relation."""
    edges, rest = [], np.ones(len(linked), dtype=bool)
    for root in range(len(linked)):
        if not rest[root]:
            continue
        rest[root] = False
        queue = [root]
        while queue:
            q = queue.pop()
            reached = np.flatnonzero(linked[q] & rest)
            rest[reached] = False
            edges += [(q, r) for r in reached]
            queue += reached.tolist()
    return edges


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    min_cosine: float = MIN_COSINE, trees: int = TREES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``table``.

    Rows are compared within one non-null label and one length. Null or zero vectors, and those with
    null or non-finite components, link with nothing: no links, their own id, kept. Equal vectors
    are one class in the search and count each other as links. ``component_id`` is the smallest
    non-null id reachable. The trees' split points are fitted on a sample bounded by ``SAMPLE``; all
    vectors are in the index. An empty table gives no rows.
    """
    vector = F.col(vector_col)
    sound = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(sound & F.col(label_col).isNotNull(), F.lit(False)).alias("usable"),
        F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"),
    )
    classes = classes_of(rows)
    found = settle(leaf_links(classes, min_cosine, trees))
    reached = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    joined = settle(classes.select("cid", "label", "h1", "h2", "copies", "first_id").join(reached, "cid", "left").join(roots, "cid", "left")
                    .withColumn("root", F.coalesce("root", "cid")))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = joined.join(smallest, "root").select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keys = rows.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), "h1", "h2", "usable")
    rows_found = keys.join(known, ["label", "h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows_found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
