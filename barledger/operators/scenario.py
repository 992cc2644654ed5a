"""What-if edits of a book and deltas of every diagnostic against a baseline book.

A scenario is another ``book_id`` in the same tables, so many scenarios run as one job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.ordered import drop_borrowed, lay_out, rolling_product
from barledger.operators.book import WEIGHT_TOLERANCE
from barledger.operators.performance import COMBINED
from barledger.session import settle

TAIL_WINDOWS = {"1M": 21, "3M": 63, "6M": 126, "1Y": 252}
PERIOD_METRICS = ("sharpe", "ann_return", "ann_vol", "max_dd")


class ScenarioEditError(ValueError):
    """An edit that does not fit the book."""


class Book(NamedTuple):
    """Portfolio and holding rows of one ``book_id``."""

    portfolio: DataFrame
    holding: DataFrame

    def renamed(self, book_id: str) -> "Book":
        tag = F.lit(book_id)
        return Book(self.portfolio.withColumn("book_id", tag), self.holding.withColumn("book_id", tag))


def union_books(books: Sequence[Book]) -> Book:
    portfolio, holding = books[0]
    for other in books[1:]:
        portfolio, holding = portfolio.unionByName(other.portfolio), holding.unionByName(other.holding)
    return Book(portfolio, holding)


EDITS = "book_id string, op string, name string, into string, place int, roles array<string>"
WEIGHTS = "book_id string, name string, ticker string, new_weight double"
#: Edits that take a portfolio out of its book.
LEAVING = ("drop", "shift", "merge")


class Edits(NamedTuple):
    """Edits of any number of scenarios as two tables: what happens to which portfolio, and new weights.

    ``drop`` leaves a portfolio out, ``shift`` sells it and buys more of ``into``, ``merge`` puts it into one
    value-weighted portfolio ``into`` with the facts of the lowest ``place`` (and ``roles``, if given).
    """

    moves: DataFrame
    weights: DataFrame


def edit_tables(spark, moves: Sequence[tuple] = (), weights: Mapping[tuple[str, str], Mapping[str, float]] | None = None) -> Edits:
    """Tables of (book_id, op, name[, into[, place[, roles]]]) and of weights by (book_id, name)."""
    rows = [tuple(m) + (None, 0, None)[len(m) - 3:] for m in moves]
    given = [(*key, ticker, float(w)) for key, own in (weights or {}).items() for ticker, w in sorted(own.items())]
    return Edits(spark.createDataFrame(rows, EDITS), spark.createDataFrame(given, WEIGHTS))


def apply_edits(book: Book, edits: Edits) -> Book:
    """All scenarios of ``edits`` over one book, in one plan: a ``book_id`` each, ``changed`` tells the portfolios that differ.

    A portfolio is looked up by (scenario, name) in the edit tables, so work grows with scenarios times
    portfolios, not with branches. Fails on an edit that does not fit the book.
    """
    _check(book, edits)
    moves, weights = edits
    asked = moves.select("book_id").unionByName(weights.select("book_id")).agg(F.array_sort(F.collect_set("book_id"))).scalar()
    facts = [c for c in book.portfolio.columns if c not in ("book_id", "name")]
    key = ["book_id", "name"]

    def each(rows: DataFrame) -> DataFrame:
        return rows.withColumn("book_id", F.explode(asked))

    leaving = moves.where(F.col("op").isin(*LEAVING))
    gone = each(book.portfolio).join(leaving.withColumnRenamed("roles", "new_roles"), key)
    poured = gone.where("op = 'shift'").groupBy("book_id", F.col("into").alias("name")).agg(F.sum("total_value").alias("_poured"))
    reweighed = weights.groupBy(*key).agg(F.lit(True).alias("_reweighed"))
    stay = each(book.portfolio).join(leaving.select(*key), key, "left_anti").join(poured, key, "left").join(reweighed, key, "left")
    stay = stay.withColumns({
        "total_value": F.col("total_value") + F.coalesce("_poured", F.lit(0.0)),
        "changed": F.col("_poured").isNotNull() | F.col("_reweighed").isNotNull(),
    })
    merged = gone.where("op = 'merge'").groupBy("book_id", F.col("into").alias("name")).agg(
        F.min_by(F.struct(*facts), "place").alias("_first"), F.sum("total_value").alias("_total"), F.min("ord").alias("_ord"),
        F.first("new_roles", ignorenulls=True).alias("_roles"))
    own = {"total_value": F.col("_total"), "ord": F.col("_ord"), "roles": F.coalesce("_roles", "_first.roles")}
    joined = merged.select(*key, *[own.get(c, F.col("_first").getField(c)).alias(c) for c in facts], F.lit(True).alias("changed"))
    portfolio = stay.select(*key, *facts, "changed").unionByName(joined)

    held = each(book.holding.select("book_id", "name", "ticker", "weight", "value"))
    kept = held.join(stay.select(*key, "total_value", "_poured"), key).join(weights, [*key, "ticker"], "left")
    weight = F.coalesce("new_weight", "weight")
    value = F.when(F.col("_poured").isNotNull() | F.col("new_weight").isNotNull(), weight * F.col("total_value")).otherwise(F.col("value"))
    parts = held.drop("value").join(gone.where("op = 'merge'").select(*key, "into", "total_value"), key)
    blended = parts.groupBy("book_id", F.col("into").alias("name"), "ticker").agg(F.sum(F.col("weight") * F.col("total_value")).alias("value"))
    blended = blended.join(merged.select(*key, "_total"), key)
    share = F.when(F.col("_total") > 0, F.col("value") / F.col("_total")).otherwise(0.0)
    holding = kept.select(*key, "ticker", weight.alias("weight"), value.alias("value")).unionByName(
        blended.select(*key, "ticker", share.alias("weight"), "value"))
    return Book(portfolio, holding)


def _check(book: Book, edits: Edits) -> None:
    """Raise on the first edit that does not fit; all rules are one job."""
    moves, weights = edits
    known = book.portfolio.select("name", F.upper("currency").alias("currency"), F.lit(True).alias("_known"))
    targets = moves.where("op = 'shift'").select("book_id", "into", F.col("into").alias("name"), F.lit("shift").alias("op"))
    named = moves.where("op <> 'weights'").select("book_id", "into", "name", "op").unionByName(targets)
    named = named.unionByName(weights.select("book_id", F.lit(None).cast("string").alias("into"), "name", F.lit("weights").alias("op")).distinct())
    seen = named.join(known, "name", "left")
    sources = moves.where(F.col("op").isin(*LEAVING)).select("book_id", "name", F.lit(True).alias("_leaves"))

    def problem(rows: DataFrame, *words: Column | str) -> DataFrame:
        return rows.select(F.concat(*[w if isinstance(w, Column) else F.lit(w) for w in words]).alias("problem"))

    into = F.coalesce("into", F.lit(""))
    away = moves.where("op = 'shift'").join(sources.withColumnRenamed("name", "into"), ["book_id", "into"])
    taken = moves.where("op = 'merge'").select("book_id", "into").distinct().join(known.withColumnRenamed("name", "into"), "into")
    taken = taken.join(moves.where("op = 'merge'").select("book_id", F.col("name").alias("into")), ["book_id", "into"], "left_anti")
    groups = seen.where("op in ('shift', 'merge')").groupBy("book_id", "op", "into").agg(F.count_distinct("currency").alias("n"))
    twice = sources.groupBy("book_id", "name").count().where("count > 1")
    sums = weights.groupBy("book_id", "name").agg(F.sum("new_weight").alias("total")).where(F.abs(F.col("total") - 1) > WEIGHT_TOLERANCE)
    mine = book.holding.select("name", "ticker").distinct().join(weights.select("book_id", "name").distinct(), "name").withColumn("_mine", F.lit(True))
    gaps = mine.join(weights, ["book_id", "name", "ticker"], "full_outer").where("_mine IS NULL OR new_weight IS NULL")
    problems = [
        problem(seen.where("_known IS NULL"), "portfolio not found: ", F.col("name")),
        problem(moves.where(F.col("op") == "shift").where("name = into"), "source and target must differ: ", F.col("name")),
        problem(away, "the target of a shift leaves the book: ", into),
        problem(taken, F.col("into"), " is an existing portfolio outside the merge"),
        problem(groups.where("n > 1"), "mixed currencies in ", into),
        problem(twice, "more than one edit takes out ", F.col("name")),
        problem(sums, "weights of ", F.col("name"), " sum to ", F.col("total").cast("string")),
        problem(gaps, "weights of ", F.col("name"), " and its holdings differ at ", F.col("ticker")),
    ]
    found = reduce(DataFrame.unionByName, problems).limit(1).collect()
    if found:
        raise ScenarioEditError(found[0]["problem"])


def _single(book: Book, new_id: str, moves: Sequence[tuple] = (), weights: Mapping | None = None) -> Book:
    out = apply_edits(book, edit_tables(book.portfolio.sparkSession, [(new_id, *m) for m in moves], weights))
    return Book(out.portfolio.drop("changed"), out.holding)


def drop_portfolio(book: Book, name: str, new_id: str) -> Book:
    return _single(book, new_id, [("drop", name)])


def set_weights(book: Book, name: str, weights: dict[str, float], new_id: str) -> Book:
    """Replace the weights of one portfolio; every holding must be given one."""
    return _single(book, new_id, weights={(new_id, name): weights})


def rebalance_into(book: Book, source: str, target: str, new_id: str) -> Book:
    """Sell ``source`` and buy more of ``target`` at its present composition."""
    return _single(book, new_id, [("shift", source, target)])


def merge_into(book: Book, names: Sequence[str], into: str, new_id: str, roles: Sequence[str] | None = None) -> Book:
    """One value-weighted portfolio in place of several; facts come from the first named one."""
    if not names:
        raise ScenarioEditError("nothing to merge")
    return _single(book, new_id, [("merge", n, into, i, roles if roles is None else list(roles)) for i, n in enumerate(names)])


def shared_panel(portfolio: DataFrame, panel: Callable[[DataFrame], DataFrame], baseline: str) -> DataFrame:
    """Panel of all books from ``panel(portfolios)``, which is asked for the baseline and the changed portfolios only.

    ``portfolio`` has the baseline and the scenarios with ``changed``; an unchanged portfolio takes its
    rows from the baseline by name.
    """
    same = (F.col("book_id") != baseline) & ~F.col("changed")
    own = settle(panel(portfolio.where(~same)))
    members = portfolio.where(same).select("book_id", "name")
    copied = own.where(F.col("book_id") == baseline).drop("book_id").join(members, "name").select(*own.columns)
    return own.unionByName(copied)


# ------------------------------------------------------------------ deltas


def _against(rows: DataFrame, baseline: str, on: Sequence[str], cols: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Scenario rows next to the baseline rows with the same ``on`` values, as ``cur_``/``prop_`` columns."""
    proposed = rows.where(F.col("book_id") != baseline).select(
        "book_id", *on, *[F.col(c).alias(f"prop_{c}") for c in cols]
    )
    current = rows.where(F.col("book_id") == baseline).select(*on, *[F.col(c).alias(f"cur_{c}") for c in cols])
    current = current.withColumn("book_id", F.explode(_scenario_ids(rows, baseline)))
    return current.join(proposed, ["book_id", *on], how)


def _scenario_ids(rows: DataFrame, baseline: str) -> Column:
    """All other books as one array, an entry per scenario: baseline rows are repeated by it, not joined on a constant."""
    return rows.where(F.col("book_id") != baseline).agg(F.coalesce(F.collect_set("book_id"), F.array().cast("array<string>"))).scalar()


def _minus(col: str) -> Column:
    return F.col(f"prop_{col}") - F.col(f"cur_{col}")


def performance_deltas(performance: DataFrame, baseline: str) -> DataFrame:
    cols = ("sharpe", "ann_return", "ann_vol", "max_dd", "aum")
    both = _against(performance, baseline, [], cols, "inner")
    return both.select("book_id", *[_minus(c).alias(f"{c}_delta") for c in cols])


def portfolio_deltas(comparison: DataFrame, baseline: str) -> DataFrame:
    """Per portfolio present in both books, the combined row left out."""
    cols = ("sharpe", "annualised_vol", "max_dd")
    both = _against(comparison.where(F.col("name") != COMBINED), baseline, ["name"], cols, "inner")
    return both.select("book_id", "name", _minus("sharpe").alias("sharpe_delta"),
                       _minus("annualised_vol").alias("vol_delta"), _minus("max_dd").alias("max_dd_delta"))


def exposure_deltas(exposure: DataFrame, baseline: str) -> DataFrame:
    cols = ("value", "weight")
    both = _against(exposure, baseline, ["dimension", "bucket"], cols)
    both = both.fillna(0.0, [f"{side}_{c}" for side in ("cur", "prop") for c in cols])
    return both.withColumns({"weight_delta": _minus("weight"), "value_delta": _minus("value")})


def period_deltas(periods: DataFrame, baseline: str) -> DataFrame:
    """Periods of either side; a missing side stays NULL. ``period_ord`` keeps the usual order."""
    both = _against(periods, baseline, ["period", "period_ord"], PERIOD_METRICS)
    return both.withColumns({f"delta_{m}": _minus(m) for m in PERIOD_METRICS})


def tail_extremes(nav: DataFrame, timeframe: str = "1m") -> DataFrame:
    """Best and worst compounded return of each window length per book, with the end date.

    Of equal extremes the earliest date counts. A series shorter than a window gives NULLs.
    """
    laid, lane = lay_out(nav, ["book_id"], "ts", timeframe, max(TAIL_WINDOWS.values()) + 1, 0)
    steps = laid.withColumn("_r", F.try_divide(F.col("nav"), F.lag("nav").over(lane.window())))
    rolled = steps.withColumns({f"_w{n}": rolling_product(F.col("_r"), lane, n) - 1 for n in TAIL_WINDOWS.values()})
    points = F.inline(F.array(*[
        F.struct(F.lit(label).alias("horizon"), F.col(f"_w{n}").alias("v")) for label, n in TAIL_WINDOWS.items()
    ]))
    long = drop_borrowed(rolled, lane).select("book_id", "ts", points)
    day = F.date_diff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    known = F.col("v").isNotNull()
    best = F.max(F.when(known, F.struct("v", (-day).alias("d"), "ts")))
    worst = F.min(F.when(known, F.struct("v", day.alias("d"), "ts")))
    ends = long.groupBy("book_id", "horizon").agg(best.alias("_b"), worst.alias("_w"))
    return ends.select(
        "book_id", "horizon",
        F.col("_b.v").alias("best"), F.col("_b.ts").cast("date").alias("best_date"),
        F.col("_w.v").alias("worst"), F.col("_w.ts").cast("date").alias("worst_date"),
    )


def tail_deltas(nav: DataFrame, baseline: str, timeframe: str = "1m") -> DataFrame:
    both = _against(tail_extremes(nav, timeframe), baseline, ["horizon"], ("best", "best_date", "worst", "worst_date"))
    return both.withColumns({"delta_best": _minus("best"), "delta_worst": _minus("worst")})


def _lifecycle() -> Column:
    return (
        F.when(F.col("cur_rho").isNull(), "appeared").when(F.col("prop_rho").isNull(), "disappeared").otherwise("persisted")
    )


def redundancy_deltas(pairs: DataFrame, scenarios: DataFrame, baseline: str) -> DataFrame:
    """Redundant pairs that appeared, disappeared or persisted, regardless of name order.

    ``scenarios`` lists every ``book_id``, so one without any pair left is seen too.
    """
    keyed = pairs.withColumns({"pair_a": F.least("name_a", "name_b"), "pair_b": F.greatest("name_a", "name_b")})
    on = ["book_id", "pair_a", "pair_b"]
    current = keyed.where(F.col("book_id") == baseline).select("pair_a", "pair_b", F.col("rho").alias("cur_rho"))
    current = current.withColumn("book_id", F.explode(_scenario_ids(scenarios, baseline)))
    proposed = keyed.where(F.col("book_id") != baseline).select(*on, F.col("rho").alias("prop_rho"))
    return current.join(proposed, on, "full_outer").withColumn("status", _lifecycle())


def leaderboard(performance: DataFrame, redundancy: DataFrame, baseline: str) -> DataFrame:
    """One row per scenario: headline deltas and how many redundant pairs came and went."""
    counts = redundancy.groupBy("book_id").agg(
        F.count_if(F.col("status") == "appeared").alias("n_appeared"),
        F.count_if(F.col("status") == "disappeared").alias("n_disappeared"),
    )
    rows = performance_deltas(performance, baseline).join(counts, "book_id", "left")
    return rows.fillna(0, ["n_appeared", "n_disappeared"])
