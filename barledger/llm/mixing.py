"""Mixing sources to target weights by Efraimidis-Spirakis keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.llm.common import WORD_CLASS, settle

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Least quality weight; the most is 1.
LEAST_WEIGHT = 0.1
#: Slices of the key range per source; a slice is what one window task orders.
SLICES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight in [0.1, 1]: the share of letters, of any script, among the characters that are not white space."""
    shown = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.coalesce(LEAST_WEIGHT + (1 - LEAST_WEIGHT) * letters / F.greatest(shown, F.lit(1)), F.lit(LEAST_WEIGHT))


def key_slice(key: Column, slices: int = SLICES) -> Column:
    """Slice of a key, rising with it: each holds at most 1.85 of ``slices`` parts of a source, whatever the weights.

    A key of weight ``w`` has the density ``w exp(-w key)``. The largest of these over all ``w`` from ``LEAST_WEIGHT`` to 1 is
    that of 1 up to the key 1, of ``1 / key`` up to ``1 / LEAST_WEIGHT``, then of the least weight; slices
    have equal areas under this envelope.
    """
    e, far = math.exp(-1), 1 / LEAST_WEIGHT
    whole = 1 - e + e * math.log(far) + e
    area = (F.when(key < 1, 1 - F.exp(-key)).when(key < far, 1 - e + e * F.log(key))
            .otherwise(whole - F.exp(-LEAST_WEIGHT * key)))
    return F.least(F.floor(area / whole * slices), F.lit(slices - 1)).cast("int")


def uniform(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """Number in (0, 1) from the id alone (without one, from the text), the same in every run."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(name, F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def measured_columns(seed: int = 0) -> dict[str, Column]:
    """``size`` and ``sample_key`` over ``doc_id`` and ``text``."""
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality(F.col("text"))
    return {"size": words(F.col("text")), "sample_key": key}


def measured(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, sample_key`` of every row; the smaller the key the sooner the row is taken."""
    own = measured_columns(seed)
    return docs.select("doc_id", "source", own["size"].alias("size"), own["sample_key"].alias("sample_key"))


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target``: the sum of all sizes shared by weight, no target above ``max_epochs`` sizes.

    Sources by code point, null last, take the weights in turn. The level of the share follows in
    closed form: in the order of ``max_epochs * size / weight`` a source is at its limit as long as
    that ratio is within the level of those not yet at theirs. One row per source is all that meets
    here; documents are summed before.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    limits = weighed.withColumn("limit", max_epochs * F.col("source_size"))
    every = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    levels = limits.withColumn("level", left / F.sum("weight").over(after))
    open_level = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))
    first_open = levels.withColumn("share", F.first(open_level, ignorenulls=True).over(whole))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("share") * F.col("weight"), F.col("limit").cast("double")))
    return first_open.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs``.

    ``taken`` counts words: complete epochs of the source first, then rows in the order of their
    exponential keys until the rest of the target is filled; the row at the end gives the words that
    still fit. The prefix sum runs over slices of the key range (``key_slice``), so a source of any share is
    spread over many tasks. Null text has size 0 and is never taken; null sources form one source; rows
    with one id share a key, so that equal rows are interchangeable. An empty table gives no rows.
    """
    placed = _placed(docs, weights, max_epochs, seed)
    return placed.select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def _taken() -> Column:
    return (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")


def _placed(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int) -> DataFrame:
    """Measured rows with ``name`` of their source, complete ``epochs`` and ``extra`` words of the pass that is cut short."""
    rows = settle(measured(docs, seed))
    sliced = rows.withColumns({"name": source_name(), "slice": key_slice(F.col("sample_key"))})
    sums = sliced.groupBy("name", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    targets = source_targets(rows, weights, max_epochs).withColumn("name", source_name()).drop("source")
    earlier = Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).join(targets, "name")
    begun = starts.select("name", "slice", "slice_start", "source_size", "target")
    inside = Window.partitionBy("name", "slice").orderBy("sample_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.join(begun, ["name", "slice"]).withColumn("start", F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.withColumns({"epochs": epochs, "extra": extra})


def source_name() -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` as often as the mixture takes them, with all their columns.

    Complete passes repeat the row. The one row of a source that gives a part gives its first words
    up to that count, white space between them included, and ``n_chars``, if there, follows the text. Rows not taken go.

    The pass that is cut short takes all rows of a source below one key, so a row knows its part from its
    own key and that of its source's cut: texts are not shuffled. Only rows that have the key of the
    cut, copies of one id as a rule, are numbered to share what is left.
    """
    placed = settle(_placed(docs, weights, max_epochs, seed))
    # a row per source, written so that its measured size decides how the rows meet it
    cuts = settle(placed.groupBy("name").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("extra") > 0, F.col("sample_key"))).alias("cut")))
    measure = measured_columns(seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.col("text").cast("string").alias("text"))
    keyed = rows.withColumns({"size": measure["size"], "name": source_name()}).withColumn("sample_key", measure["sample_key"])
    here = keyed.join(cuts, "name").where((F.col("size") > 0) & ~F.col("sample_key").eqNullSafe(F.col("cut")))
    whole = F.col("epochs") + F.when(F.col("sample_key") < F.col("cut"), 1).otherwise(0)
    sure = here.select("row", "size", (whole * F.col("size")).alias("taken"))
    at_cut = placed.join(cuts.select("name", "cut"), "name").where(F.col("sample_key") == F.col("cut"))
    both = sure.unionByName(_shared(rows, at_cut.select("doc_id", "source", "size", _taken().alias("taken"))))
    passes = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    times = both.where("taken > 0").select("row", "size", "taken", F.explode(passes).alias("pass"))
    part = F.least(F.col("size"), F.col("taken") - (F.col("pass") - 1) * F.col("size"))
    out = times.withColumn("body", F.when(part < F.col("size"), first_words(F.col("row.text"), part)).otherwise(F.col("row.text")))
    fresh = {"text": F.col("body")} | ({"n_chars": F.length("body").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0)), F.lit(1), n.cast("int"))
    gaps = F.slice(F.split(text, WORD_CLASS), F.lit(1), n.cast("int"))
    return F.array_join(F.zip_with(gaps, words, lambda gap, word: F.concat(gap, word)), "")


def _shared(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``row, size, taken`` of the rows with an id and source in ``taken``; rows of one id, source and size are numbered on both sides."""
    near = F.xxhash64("doc_id", "source")
    ids = settle(taken.select(near.alias("near")).distinct())
    found = rows.withColumn("near", near).join(ids, "near", "left_semi").withColumn("size", words(F.col("text")))
    group = ["doc_id", "source", "size"]
    same = F.xxhash64(*group)
    nth = lambda *more: F.row_number().over(Window.partitionBy("same").orderBy(*group, *more))
    left = found.withColumn("same", same).select("row", "same", "size", nth(F.xxhash64("row")).alias("nth"))
    right = taken.where("size > 0").withColumn("same", same).select("taken", F.col("same").alias("with"), nth(F.desc("taken")).alias("place"))
    # rows of one group stand in the same order on both sides; the difference keeps the join on ``same`` alone
    return left.join(right, (F.col("same") == F.col("with")) & (F.col("nth") - F.col("place") == 0)).select("row", "size", "taken")
