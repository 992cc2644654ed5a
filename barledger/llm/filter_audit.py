"""Interaction of document filters: removal counts of all coalitions, their Hart-Mas-Colell potential, every order step by step."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.llm.common import WORD_CLASS

#: Stands for the filter that fails a row whose text some row of a smaller id has as well.
COPIES = "copies"


def default_filters() -> dict[str, Column | str]:
    """Failure conditions by letter, over ``text`` and its ``words``."""
    n = F.size("words")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
        "E": COPIES,
    }


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str]) -> DataFrame:
    """``part, mask, good, toxic, n``: rows per language by the set of filters they fail (bit 0: the first) and by label.

    Texts leave the first scan as a digest and a mask. Copies are counted per digest, mask, part and
    label before they meet, so a text with any number of copies is a handful of rows. Rows without an
    id are no copies of others and make no others copies; they carry no label. A label row repeated
    for one id counts once, as 1 if any of its rows says so.
    """
    names = list(filters)
    copies = [i for i, name in enumerate(names) if filters[name] is COPIES]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0)))
    mask = F.lit(0)
    for i, name in enumerate(names):
        if i not in copies:
            mask = mask + F.when(filters[name], 1 << i).otherwise(0)
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    # rows without an id find no label; their digest spreads them over the tasks of the join
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[
        F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    rows = rows.fillna(0, ["good", "toxic"])
    kind = ["part", "mask", "good", "toxic"]
    single = rows.groupBy("doc_id", "spread", "digest", *kind).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = single.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"), F.min(named).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    counted = groups.withColumn("least", least).withColumn("originals", originals)
    extra = sum(1 << i for i in copies)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(extra)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    split = counted.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def coalitions(found: DataFrame, n_filters: int) -> DataFrame:
    """``part, total, removed, good, toxic``: what every coalition of filters removes, arrays by its bit set."""
    fails = [(F.col("mask").bitwiseAND(F.lit(s)) != 0).cast("int") for s in range(1 << n_filters)]
    summed = lambda what: F.array(*[F.sum(F.col("n") * f * what) for f in fails])
    return found.groupBy("part").agg(
        F.sum("n").alias("total"), summed(F.lit(1)).alias("removed"), summed(F.col("good")).alias("good"), summed(F.col("toxic")).alias("toxic"))


def potentials(removed: Column, n_filters: int, scale: int) -> Column:
    """Potential of every coalition times ``scale``: its worth plus the potentials without one member each, over its size.

    The empty coalition has 0, and a coalition comes after all that lack one of its members, so one
    pass over the bit sets in order is the recursion. ``scale`` is a multiple of all sizes' least
    common multiple, which keeps the division exact.
    """

    def next_one(known: Column, s: Column) -> Column:
        without = F.lit(0).cast("long")
        for i in range(n_filters):
            bit = F.lit(1 << i)
            without = without + F.when(s.bitwiseAND(bit) != 0, F.get(known, s - bit)).otherwise(F.lit(0).cast("long"))
        worth = F.lit(scale).cast("long") * F.get(removed, s)
        size = F.bit_count(s)
        total = worth + without
        return F.concat(known, F.array(((total - total % size) / size).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), next_one)


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Effect of every filter at its place in every order of the filters, per language.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``. A step is the difference of two coalitions: those before it with and without its
    filter. ``shapley`` is the potential of all filters minus that without this one, times the
    number of orders: what the filter removes, summed over all orders. ``filters`` names conditions
    by one letter each (six at most, as their orders are listed); ``COPIES`` marks the filter of repeated texts.

    A null text is empty; a null language is the part ``''``; null labels count as 0; rows without an
    id are never copies. An empty table has no parts, hence no rows; extra columns are not read.
    """
    filters = filters or default_filters()
    letters = "".join(filters)
    n = len(letters)
    assert n == len(filters) <= 6, "one letter a filter, six at most"
    orders = ["".join(p) for p in permutations(letters)]
    full = (1 << n) - 1
    worth = coalitions(cells(docs, labels, filters), n)
    worth = worth.withColumn("potential", potentials(F.col("removed"), n, len(orders)))
    listed = worth.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
    listed = listed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    alphabet = F.array(*[F.lit(x) for x in letters])
    bits = F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.array_position(alphabet, c) - 1).cast("int"))
    steps = listed.withColumn("bits", bits).withColumn("bit", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    steps = steps.withColumn("after", F.col("before") + F.col("bit"))
    gain = lambda what: F.get(what, F.col("after")) - F.get(what, F.col("before"))
    rest = F.lit(full) - F.col("bit")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("removed", F.col("after"))).alias("kept"),
        gain("removed").alias("removed"),
        (F.get("removed", F.col("bit")) - gain("removed")).alias("redundant"),
        (F.get("removed", F.lit(full)) - F.get("removed", rest)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(full)) - F.get("potential", rest)).alias("shapley"))
