"""Modelled against observed value over a timeline of anchors, with deposits and target changes.

A portfolio's timeline has anchors (snapshots and the end date), target changes and deposits. Two
models run along it:

* **lots** - every (re)balance and every deposit buys a lot that is then held; the value of a lot at
  a date is its amount times the price ratios of its weights times the fees in between. Only the
  amount of the next rebalance depends on the lots before it: ``next = amount * A + B``.
* **rebalanced** - the value earns the weighted return of every bar: ``next = value * f + deposit``.

Both recursions are running compositions of affine steps, one per target change or timeline date
(``functions.ordered``); everything that grows with prices is joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.functions.calendars import calendar_days, month_before
from barledger.functions.ordered import Lane, drop_borrowed, lay_out, running, unblock
from barledger.operators.asof import as_of, as_of_single, effective_targets, target_intervals
from barledger.operators.book import CASH_PREFIX, with_role
from barledger.operators.projection import PORTFOLIO
from barledger.operators.reconcile import last_rate
from barledger.session import settle
from barledger.schema import DAILY

DEPOSIT_SPREAD = 0.002
# Gap status limits in percent (fixed values).
GAP_EXACT, GAP_OK, GAP_NOISE = 0.05, 0.3, 1.0
SEED_TOLERANCE = 1e-4


def gap_status(gap_pct: Column) -> Column:
    size = F.abs(gap_pct)
    return (
        F.when(size.isNull(), "no app value").when(size < GAP_EXACT, "exact").when(size < GAP_OK, "ok")
        .when(size < GAP_NOISE, "noise").otherwise("warn")
    )


def convert(amount: Column, source: Column, target: Column, rate: Column) -> Column:
    """USD and SGD into each other; any other pair passes through."""
    src, dst = F.upper(source), F.upper(target)
    return (
        F.when((src == "SGD") & (dst == "USD"), amount / rate)
        .when((src == "USD") & (dst == "SGD"), amount * rate).otherwise(amount)
    )


def deposit_value(amount: Column, source: Column, target: Column, stated: Column, rate: Column) -> Column:
    """Deposit in portfolio currency: the stated rate, else the market rate less the spread."""
    crossed = F.upper(source) != F.upper(target)
    known = F.upper(source).isin("USD", "SGD") & F.upper(target).isin("USD", "SGD")
    market = convert(amount, source, target, rate) * F.when(crossed & known, 1 - DEPOSIT_SPREAD).otherwise(1.0)
    return F.when(stated > 0, amount * stated).otherwise(market)


def new_sleeves(
    portfolio: DataFrame, deposits: DataFrame, observed_end: DataFrame, targets: DataFrame,
    universe: DataFrame, fx: DataFrame, book_id: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Portfolios that appear only through a first deposit: (portfolio, holding, residual deposits).

    Weights are the targets in force at that deposit, else the earliest; unknown assets drop out.
    """
    fresh = deposits.join(portfolio.select("name").distinct(), "name", "left_anti").join(
        observed_end.select("name").distinct(), "name", "left_semi"
    )
    first = Window.partitionBy("name").orderBy("date", "amount")
    seeds = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    dates = targets.groupBy("name").agg(F.min("eff_date").alias("_first"))
    asked = seeds.join(dates, "name").select(
        F.lit(book_id).alias("book_id"), "name", F.greatest("date", "_first").alias("_at")
    )
    weights = effective_targets(asked, targets, F.col("_at")).where("weight > 0").join(universe.select("ticker"), "ticker", "left_semi")
    total = weights.groupBy(*PORTFOLIO).agg(F.sum("weight").alias("_total"))
    off = F.abs(F.col("_total") - 1) > SEED_TOLERANCE
    scaled = weights.join(total, PORTFOLIO).withColumn(
        "weight", F.when(off, F.col("weight") / F.col("_total")).otherwise(F.col("weight"))
    )
    kept = seeds.join(scaled.select("name").distinct(), "name", "left_semi")
    holding = scaled.join(kept.select("name", "amount"), "name").select(
        *PORTFOLIO, "ticker", "weight", (F.col("weight") * F.col("amount")).alias("value")
    )
    rated = as_of_single(kept, fx, "date", "rate", "_rate", timeframe=DAILY)
    usd = F.upper("currency") == "USD"
    made = rated.select(
        F.lit(book_id).alias("book_id"), "name", F.lit(None).cast("int").alias("ord"),
        F.col("date").alias("statement_date"), F.col("amount").alias("total_value"), F.upper("currency").alias("currency"),
        F.array(F.lit("holding")).alias("roles"), F.lit(0.0).alias("fee_annual"), F.when(usd, F.col("_rate")).alias("statement_fx"),
    )
    residual = deposits.join(kept.select("name", "date", "amount"), ["name", "date", "amount"], "left_anti")
    return made, holding, residual


def anchor_timeline(
    portfolio: DataFrame, observed: DataFrame, deposits: DataFrame, fx: DataFrame, end: Column, hidden: bool = False
) -> DataFrame:
    """Anchors per holding portfolio: every snapshot date up to the end, and the end itself.

    Leading dates without an observation are dropped; if the first deposit lies between the last of
    them and the first observation, it becomes the first anchor. ``hidden`` adds the date one month
    before the end. ``observed`` holds ``name, snap_date, base_value, sgd_value``.
    """
    end_day = end.cast("date")
    held = with_role(portfolio).select(*PORTFOLIO, "currency")
    # one array of the snapshot dates, a sheet's columns; every portfolio has a row on each of them
    days = observed.where(F.col("snap_date") <= end_day).agg(F.collect_set("snap_date")).scalar()
    grid = held.withColumn("snap_date", F.explode(F.array_distinct(F.array_append(days, end_day))))
    seen = observed.where(F.col("base_value") > 0).select("name", "snap_date", "base_value", "sgd_value")
    grid = grid.join(seen, ["name", "snap_date"], "left").withColumn("last_fx", last_rate(fx).scalar())
    usd = F.upper("currency") == "USD"
    grid = grid.select(
        *PORTFOLIO, "currency", F.col("snap_date").alias("anchor_date"), F.col("base_value").alias("observed"),
        F.col("sgd_value").alias("observed_base"),
        F.when(F.col("base_value").isNotNull(), F.col("sgd_value") / F.col("base_value"))
        .when(F.col("snap_date") == end_day, F.when(usd, F.col("last_fx")).otherwise(1.0)).alias("fx"),
        "last_fx",
    )
    grid = settle(grid)
    starts = grid.groupBy(*PORTFOLIO, "currency", "last_fx").agg(
        F.min(F.when(F.col("observed").isNotNull(), F.col("anchor_date"))).alias("_first")
    ).where(F.col("_first").isNotNull())
    before = grid.join(starts.select(*PORTFOLIO, "_first"), PORTFOLIO).where(F.col("anchor_date") < F.col("_first"))
    before = before.groupBy(*PORTFOLIO).agg(F.max("anchor_date").alias("_prev"))
    first_deposit = deposits.groupBy("name").agg(F.min_by(F.struct("date", "currency", "amount", "fx_to_base"), "date").alias("d"))
    seeds = starts.join(before, PORTFOLIO).join(first_deposit, "name").where(
        (F.col("d.date") >= F.col("_prev")) & (F.col("d.date") < F.col("_first")) & (F.col("d.amount") > 0)
    ).select(*PORTFOLIO, "currency", "last_fx", F.col("d.date").alias("date"), F.col("d.currency").alias("_ccy"),
             F.col("d.amount").alias("amount"), F.col("d.fx_to_base").alias("_stated"))
    seeds = as_of_single(seeds, fx, "date", "rate", "_rate", timeframe=DAILY)
    rate = F.coalesce("_rate", "last_fx")
    native = deposit_value(F.col("amount"), F.col("_ccy"), F.col("currency"), F.col("_stated"), rate)
    base = (
        F.when(F.upper("_ccy") == "SGD", F.col("amount")).when(F.upper("currency") == "SGD", native).otherwise(native * rate)
    )
    synthetic = seeds.select(
        *PORTFOLIO, "currency", F.col("date").alias("anchor_date"), native.alias("observed"), base.alias("observed_base"),
        F.when(native > 0, base / native).otherwise(1.0).alias("fx"),
    )
    real = grid.join(starts.select(*PORTFOLIO, "_first"), PORTFOLIO).where(F.col("anchor_date") >= F.col("_first")).drop("_first", "last_fx")
    anchors = real.unionByName(synthetic).withColumn("is_hidden", F.lit(False))
    if not hidden:
        return anchors
    anchors = settle(anchors)
    span = anchors.groupBy(*PORTFOLIO, "currency").agg(F.min("anchor_date").alias("_a"), F.max("anchor_date").alias("_b"))
    extra = span.withColumn("anchor_date", month_before(end_day)).where(
        (F.col("_a") < F.col("anchor_date")) & (F.col("anchor_date") < F.col("_b"))
    ).join(anchors.select(*PORTFOLIO, "anchor_date"), [*PORTFOLIO, "anchor_date"], "left_anti")
    extra = as_of_single(extra, fx, "anchor_date", "rate", "_rate", timeframe=DAILY).select(
        *PORTFOLIO, "currency", "anchor_date", F.lit(None).cast("double").alias("observed"),
        F.lit(None).cast("double").alias("observed_base"),
        F.when(F.upper("currency") == "SGD", 1.0).otherwise(F.col("_rate")).alias("fx"), F.lit(True).alias("is_hidden"),
    )
    return anchors.unionByName(extra)


def boundaries(
    portfolio: DataFrame, anchors: DataFrame, targets: DataFrame, deposits: DataFrame, fx: DataFrame,
    rebalance_on_anchor: bool = False,
) -> DataFrame:
    """All dates at which something happens, with deposits in portfolio currency and cumulative fee.

    A target change on an anchor date does not rebalance the lots unless asked for.
    """
    span = anchors.groupBy(*PORTFOLIO, "currency").agg(F.min("anchor_date").alias("_a"), F.max("anchor_date").alias("_b"))
    marks = anchors.select(*PORTFOLIO, F.col("anchor_date").alias("day"), F.lit(1).alias("is_anchor"), F.lit(0).alias("is_change"), F.lit(0.0).alias("deposit"))
    changed = span.join(targets.select("name", F.col("eff_date").alias("day")).distinct(), "name").where(
        (F.col("day") > F.col("_a")) & (F.col("day") <= F.col("_b"))
    ).select(*PORTFOLIO, "day")
    if not rebalance_on_anchor:
        changed = changed.join(marks.select(*PORTFOLIO, "day"), [*PORTFOLIO, "day"], "left_anti")
    changed = changed.select("*", F.lit(0).alias("is_anchor"), F.lit(1).alias("is_change"), F.lit(0.0).alias("deposit"))
    paid = span.join(deposits.withColumnRenamed("currency", "_ccy"), "name").where(
        (F.col("date") > F.col("_a")) & (F.col("date") <= F.col("_b"))
    )
    paid = as_of_single(paid, fx, "date", "rate", "_rate", timeframe=DAILY)
    native = convert(F.col("amount"), F.col("_ccy"), F.col("currency"), F.coalesce("_rate", F.lit(1.0)))
    paid = paid.select(*PORTFOLIO, F.col("date").alias("day"), F.lit(0).alias("is_anchor"), F.lit(0).alias("is_change"), native.alias("deposit"))
    merged = marks.unionByName(changed).unionByName(paid).groupBy(*PORTFOLIO, "day").agg(
        F.max("is_anchor").alias("is_anchor"), F.max("is_change").alias("is_change"), F.sum("deposit").alias("deposit")
    )
    fees = portfolio.select(*PORTFOLIO, F.coalesce("fee_annual", F.lit(0.0)).alias("_fee"))
    along = Window.partitionBy(*PORTFOLIO).orderBy("day")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.join(fees, PORTFOLIO).withColumn("prev_day", F.lag("day").over(along))
    kept = 1 - F.col("_fee") * F.coalesce(F.date_diff("day", "prev_day"), F.lit(0)) / 365.0
    merged = merged.withColumn("kept", kept)
    return merged.withColumns({
        "fee_chain": F.product("kept").over(upto),
        "epoch": F.sum("is_change").over(upto),
        "deposits_cum": F.sum("deposit").over(upto),
    }).drop("_fee")


def _weights_at(points: DataFrame, at: str, holding: DataFrame, targets: DataFrame) -> DataFrame:
    """Target weights in force at ``at``, else the portfolio's own weights, joined to ``points``."""
    spans = target_intervals(targets)
    valid = (F.col(at) >= F.col("eff_date")) & (F.col("eff_to").isNull() | (F.col(at) < F.col("eff_to")))
    dated = points.join(spans.select("name", "eff_date", "eff_to"), "name").where(valid).drop("eff_to")
    with_target = dated.join(targets, ["name", "eff_date"]).drop("eff_date")
    own = points.join(dated.select(*PORTFOLIO, at), [*PORTFOLIO, at], "left_anti")
    return with_target.unionByName(own.join(holding.select(*PORTFOLIO, "ticker", "weight"), PORTFOLIO).select(*with_target.columns))


def _price_at(rows: DataFrame, prices: DataFrame, at: str, out: str) -> DataFrame:
    priced = as_of(rows, prices, ["ticker"], at, "close", out, timeframe=DAILY).drop(f"{out}_ts")
    return priced.withColumn(out, F.when(F.startswith("ticker", F.lit(CASH_PREFIX)), 1.0).otherwise(F.col(out)))


def multi_anchor(
    portfolio: DataFrame, holding: DataFrame, anchors: DataFrame, targets: DataFrame, prices: DataFrame,
    deposits: DataFrame, fx: DataFrame, rebalance_on_anchor: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(sleeves, holdings): modelled values per anchor, and per anchor and asset.

    Sleeves carry ``model_bh`` (lots), ``model_dr`` (rebalanced), ``observed`` and ``deposits_cum``.
    """
    marks = settle(boundaries(portfolio, anchors, targets, deposits, fx, rebalance_on_anchor))
    start = anchors.groupBy(*PORTFOLIO).agg(F.min_by("observed", "anchor_date").alias("opening"), F.min("anchor_date").alias("_a"))
    held = settle(_units_held(marks, start, holding, targets, prices))
    amounts = _rebalance_amounts(marks, held, start)
    shown = held.where("is_anchor = 1").join(amounts, [*PORTFOLIO, "epoch"])
    value = F.col("base") * F.col("amount") + F.col("paid")
    by_asset = settle(shown.select(*PORTFOLIO, F.col("day").alias("anchor_date"), "ticker", value.alias("value")))
    lots = by_asset.groupBy(*PORTFOLIO, "anchor_date").agg(F.sum("value").alias("model_bh"))
    rebalanced = _rebalanced_values(marks, start, holding, targets, prices)
    cum = marks.where("is_anchor = 1").select(*PORTFOLIO, F.col("day").alias("anchor_date"), "deposits_cum")
    on = [*PORTFOLIO, "anchor_date"]
    sleeves = anchors.join(cum, on).join(lots, on, "left").join(rebalanced, on, "left").fillna(0.0, ["model_bh"])
    holdings = _price_at(by_asset, prices, "anchor_date", "price")
    return sleeves, holdings


def _units_held(marks: DataFrame, start: DataFrame, holding: DataFrame, targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Value per asset and boundary of the lots running there, as ``base`` per unit of the epoch's amount plus ``paid``.

    A lot is worth ``weight / (price * fees)`` units of its asset when bought; the units of an epoch add
    up over its lots, and a boundary reads the running sum at its own price and fees. An anchor looks
    at the epoch it lies in, a target change at the one it ends.
    """
    lots = marks.join(start, PORTFOLIO).select(
        *PORTFOLIO, F.col("day").alias("lot_day"), "epoch", "fee_chain",
        F.when((F.col("day") == F.col("_a")) | (F.col("is_change") == 1), "base").when(F.col("deposit") != 0, "deposit").alias("lot"),
        F.when((F.col("day") != F.col("_a")) & (F.col("is_change") == 0), F.col("deposit")).alias("paid_in"),
    ).where(F.col("lot").isNotNull())
    bought = _price_at(_weights_at(lots, "lot_day", holding, targets).where("weight > 0"), prices, "lot_day", "p_lot").where("p_lot > 0")
    unit = F.col("weight") / (F.col("p_lot") * F.col("fee_chain"))
    none = F.lit(0.0)
    series = [*PORTFOLIO, "epoch", "ticker"]
    units = settle(bought.groupBy(*series, F.col("lot_day").alias("day")).agg(
        F.sum(F.when(F.col("lot") == "base", unit).otherwise(none)).alias("base"),
        F.sum(F.when(F.col("lot") == "deposit", unit * F.col("paid_in")).otherwise(none)).alias("paid"),
    ))
    look = [*PORTFOLIO, "day", "is_anchor", "is_change", "epoch", "fee_chain"]
    anchors = marks.where("is_anchor = 1").withColumn("is_change", F.lit(0)).select(*look)
    changes = marks.where("is_change = 1").withColumns({"is_anchor": F.lit(0), "epoch": F.col("epoch") - 1}).select(*look)
    first = units.groupBy(*series).agg(F.min("day").alias("_first"))
    asked = anchors.unionByName(changes).join(first, [*PORTFOLIO, "epoch"]).where(F.col("day") >= F.col("_first")).drop("_first")
    rows = units.unionByName(asked, allowMissingColumns=True).groupBy(*series, "day").agg(
        *[F.coalesce(F.sum(c), none).alias(c) for c in ("base", "paid")],
        *[F.max(c).alias(c) for c in ("is_anchor", "is_change", "fee_chain")],
    )
    laid, lane = lay_out(rows, series, "day", DAILY)
    summed = running(laid, lane, {"base": ("sum", F.col("base")), "paid": ("sum", F.col("paid"))})
    summed = _price_at(unblock(summed, lane).where(F.col("is_anchor").isNotNull()), prices, "day", "p_now")
    worth = F.coalesce("p_now", none) * F.col("fee_chain")
    return summed.withColumns({"base": F.col("base") * worth, "paid": F.col("paid") * worth}).drop("p_now", "fee_chain")


def _rebalance_amounts(marks: DataFrame, held: DataFrame, start: DataFrame) -> DataFrame:
    """Amount each epoch starts with: the opening observation carried through the target changes."""
    ends = held.where("is_change = 1").groupBy(*PORTFOLIO, (F.col("epoch") + 1).alias("epoch")).agg(
        F.sum("base").alias("factor"), F.sum("paid").alias("term")
    )
    changes = marks.where("is_change = 1").select(*PORTFOLIO, "epoch", "deposit").join(ends, [*PORTFOLIO, "epoch"], "left")
    term = F.coalesce("term", F.lit(0.0)) + F.col("deposit")
    steps = changes.select(*PORTFOLIO, "epoch", F.coalesce("factor", F.lit(0.0)).alias("factor"), term.alias("term"))
    opening = start.select(*PORTFOLIO, F.lit(0).cast("long").alias("epoch"), F.lit(0.0).alias("factor"), F.col("opening").alias("term"))
    # at most one target change a day, so a portfolio's steps are bounded like a daily series
    lane = Lane(tuple(PORTFOLIO), "epoch", timeframe=DAILY)
    carried = running(opening.unionByName(steps), lane, {"amount": ("affine", (F.col("factor"), F.col("term")))})
    return carried.select(*PORTFOLIO, "epoch", "amount")


def stretch_growth(stretches: DataFrame, weights: DataFrame, prices: DataFrame, **layout) -> DataFrame:
    """Growth of one unit kept at ``weights`` over the bars of each stretch ``(prev_day, day]``.

    A weighted asset is spread over the days of its stretch and meets the bar returns by (ticker, day),
    so a bar is matched once per portfolio that holds it, however many stretches a portfolio has.
    """
    laid, lane = lay_out(prices.where("close IS NOT NULL"), ["ticker"], "ts", DAILY, reach_back=1, **layout)
    returns = laid.withColumn("ret", F.col("close") / F.lag("close").over(lane.window()) - 1)
    returns = unblock(drop_borrowed(returns, lane), lane).where("ret IS NOT NULL")
    returns = returns.select("ticker", "ts", F.col("ts").cast("date").alias("bar_day"), "ret")
    held = weights.groupBy(*PORTFOLIO, "prev_day", "day", "ticker").agg(F.sum("weight").alias("weight"))
    days = calendar_days(held.withColumn("_from", F.date_add("prev_day", 1)), "_from", "day", "bar_day")
    bars = days.join(returns, ["ticker", "bar_day"])
    daily = bars.groupBy(*PORTFOLIO, "day", "ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("_r"))
    growth = daily.groupBy(*PORTFOLIO, "day").agg(F.product(1 + F.col("_r")).alias("growth"))
    return stretches.join(growth, [*PORTFOLIO, "day"], "left").fillna(1.0, ["growth"])


def _rebalanced_values(marks: DataFrame, start: DataFrame, holding: DataFrame, targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily-rebalanced value at each anchor: ``value * growth * fees + deposit`` from boundary to boundary."""
    stretches = marks.where(F.col("prev_day").isNotNull())
    weights = _weights_at(stretches.select(*PORTFOLIO, "prev_day", "day"), "prev_day", holding, targets).where("weight > 0")
    grown = stretch_growth(stretches, weights, prices)
    steps = grown.select(*PORTFOLIO, "day", "is_anchor", (F.col("growth") * F.col("kept")).alias("factor"), F.col("deposit").alias("term"))
    opening = start.select(*PORTFOLIO, F.col("_a").alias("day"), F.lit(1).alias("is_anchor"), F.lit(0.0).alias("factor"), F.col("opening").alias("term"))
    laid, lane = lay_out(opening.unionByName(steps), PORTFOLIO, "day", DAILY)
    carried = running(laid, lane, {"model_dr": ("affine", (F.col("factor"), F.col("term")))})
    return carried.where("is_anchor = 1").select(*PORTFOLIO, F.col("day").alias("anchor_date"), "model_dr")


def sleeve_reconcile(
    sleeves: DataFrame, deposits: DataFrame, observed_start: DataFrame, observed_end: DataFrame, fx: DataFrame
) -> DataFrame:
    """Modelled end value against the observed one. Deposits are shown, the model holds them already.

    ``observed_start`` and ``observed_end`` carry ``name, sgd_value``.
    """
    last = sleeves.groupBy(*PORTFOLIO, "currency").agg(F.max_by("model_bh", "anchor_date").alias("_native"))
    latest = last_rate(fx).scalar()
    valued = last.withColumn("last_fx", latest).withColumn(
        "model", F.when(F.upper("currency") == "USD", F.col("_native") * F.col("last_fx")).otherwise(F.col("_native"))
    )
    paid = as_of_single(deposits, fx, "date", "rate", "_rate", timeframe=DAILY).withColumn("last_fx", latest)
    in_base = F.when(F.upper("currency") == "SGD", F.col("amount")).otherwise(F.col("amount") * F.coalesce("_rate", "last_fx"))
    paid = paid.groupBy("name").agg(F.sum(in_base).alias("deposits"))
    a = observed_start.select("name", F.col("sgd_value").alias("start_value"))
    b = observed_end.select("name", F.col("sgd_value").alias("end_value"))
    out = valued.join(paid, "name", "left").join(a, "name", "left").join(b, "name", "left").fillna(0.0, ["deposits"])
    gap = F.col("model") - F.col("end_value")
    out = out.withColumns({"gap": gap, "gap_pct": F.try_divide(gap, F.col("end_value")) * 100})
    return out.select(*PORTFOLIO, "currency", "start_value", "end_value", "model", "deposits", "gap", "gap_pct",
                      gap_status(F.col("gap_pct")).alias("status"))


def sleeve_performance(rows: DataFrame) -> DataFrame:
    """Performance lens of the reconciliation, with one total row per book (``name`` NULL)."""
    start = F.coalesce("start_value", F.lit(0.0))
    rows = rows.withColumns({
        "perf": F.col("end_value") - F.col("start_value") - F.col("deposits"),
        "model_perf": F.when(F.col("start_value").isNotNull(), F.col("model") - start - F.col("deposits")),
    })
    base = F.when(start > 0, start).when(F.col("deposits") > 0, F.col("deposits"))
    lines = rows.withColumns({"perf_pct": F.col("perf") / base * 100, "model_perf_pct": F.col("model_perf") / base * 100})
    cols = ("start_value", "end_value", "deposits", "perf", "perf_pct", "model", "model_perf", "model_perf_pct", "gap", "gap_pct")
    sums = ("start_value", "end_value", "deposits", "perf", "model", "gap")
    total = rows.groupBy("book_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums])
    total = total.withColumn("model_perf", F.col("model") - F.col("start_value") - F.col("deposits"))
    over_start = F.when(F.col("start_value") > 0, F.col("start_value"))
    total = total.withColumns({
        "name": F.lit(None).cast("string"), "perf_pct": F.col("perf") / over_start * 100,
        "model_perf_pct": F.col("model_perf") / over_start * 100,
        "gap_pct": F.col("gap") / F.when(F.col("end_value") > 0, F.col("end_value")) * 100,
    })
    return lines.select(*PORTFOLIO, *cols).unionByName(total.select(*PORTFOLIO, *cols))


def segment_returns(sleeves: DataFrame) -> DataFrame:
    """Return of each anchor-to-anchor segment net of deposits: observed, lots and rebalanced."""
    along = Window.partitionBy(*PORTFOLIO).orderBy("anchor_date")
    paid = F.col("deposits_cum") - F.lag("deposits_cum").over(along)
    out = sleeves.withColumns({"from_date": F.lag("anchor_date").over(along), "paid": paid})
    for name, col in (("observed", "observed"), ("bh", "model_bh"), ("dr", "model_dr")):
        before = F.lag(col).over(along)
        gain = F.when(before > 0, F.col(col) - before - F.col("paid"))
        out = out.withColumns({f"{name}_gain": gain, f"{name}_return": gain / before})
    out = out.withColumns({"bh_drift": F.col("model_bh") - F.col("observed"), "bh_minus_dr": F.col("model_bh") - F.col("model_dr")})
    return out.where(F.col("from_date").isNotNull())


def cumulative_returns(sleeves: DataFrame) -> DataFrame:
    """Whole-window return net of deposits; the observed one up to its last observation."""
    known = F.when(F.col("observed").isNotNull(), F.col("anchor_date"))
    agg = sleeves.groupBy(*PORTFOLIO).agg(
        F.min_by("observed", "anchor_date").alias("first_value"),
        F.max_by("observed", known).alias("_obs"), F.max_by("deposits_cum", known).alias("_obs_paid"),
        F.max_by("model_bh", "anchor_date").alias("_bh"), F.max_by("model_dr", "anchor_date").alias("_dr"),
        F.max_by("deposits_cum", "anchor_date").alias("_paid"),
    )
    first = F.col("first_value")
    gains = {
        "observed_gain": F.col("_obs") - first - F.col("_obs_paid"),
        "bh_gain": F.col("_bh") - first - F.col("_paid"),
        "dr_gain": F.col("_dr") - first - F.col("_paid"),
    }
    agg = agg.withColumns(gains)
    return agg.withColumns({c.replace("gain", "return"): F.try_divide(F.col(c), first) for c in gains}).drop("_obs", "_obs_paid", "_bh", "_dr", "_paid")


def asset_gains(holdings: DataFrame) -> DataFrame:
    """Per asset, first value times its price return over the window."""
    agg = holdings.groupBy(*PORTFOLIO, "ticker").agg(
        F.min_by("value", "anchor_date").alias("first_value"),
        F.min_by("price", "anchor_date").alias("first_price"), F.max_by("price", "anchor_date").alias("last_price"),
    )
    change = F.try_divide(F.col("last_price"), F.col("first_price")) - 1
    return agg.withColumns({"price_return": change, "gain": F.col("first_value") * change})
