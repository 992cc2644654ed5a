"""Secrets with multipart credential linking, in column expressions and joins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.llm.common import settle

#: Base kinds in the order in which they are listed (fixed values). The character counts are checked on the match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: Weak candidates: parts of a credential that mean little alone.
IDENTIFIER = r"""(?i)\b(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
VALUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i)\b(?:https?|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp|ssh)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{4,}"""
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
BASE = KINDS[:3]
#: Characters between two parts that may belong together.
REACH = 400
_HIT = "struct<kind:int,nth:int,gap:int,size:int,sound:boolean>"


def hits(text: Column, pattern: str, kind: int, sound: Column | None = None, group: int = 0) -> Column:
    """Array of the leftmost non-overlapping matches: place in order, characters since the last one, length.

    The gaps come from a split by the same pattern. ``group`` of at least ``MIN_VALUE`` characters
    makes a match sound. Texts without a match stop at the first look.
    """
    between = F.split(text, pattern, -1)

    def hit(match: Column, nth: Column) -> Column:
        enough = F.length(F.regexp_extract(match, pattern, group)) >= MIN_VALUE if group else F.lit(True)
        return F.struct(
            F.lit(kind).alias("kind"), nth.alias("nth"), F.length(F.get(between, nth)).alias("gap"),
            F.length(match).alias("size"), enough.alias("sound"),
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hit)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_HIT}>")).cast(f"array<{_HIT}>")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``; a span is ``kind`` (place in ``KINDS``), ``start``, ``end`` in code points.

    Base kinds stand for themselves. Weak candidates (identifiers, values, endpoints) are reported
    only where complementary parts lie within ``REACH`` characters: a value near an identifier or
    access key, an identifier near a value or base secret, an endpoint near both. The interval join
    looks for the nearest part of the other class on either side, which answers it exactly with one
    ordered pass per document. A weak value inside a base span adds nothing. Spans are ordered by
    start, then kind. Null and empty texts have no spans; repeated rows are scanned each; an empty
    table gives no rows.
    """
    scanned = _scanned(docs, ["doc_id"])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.select("doc_id", "row").join(_spans(scanned), "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _scanned(docs: DataFrame, carry: Sequence[str | Column]) -> DataFrame:
    """Columns ``carry``, a row number and the hits of every row, written once: the one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, IDENTIFIER, VALUE, ENDPOINT)
    found = F.concat(*[hits(F.col("body"), p, k, group=2 if k == 0 else 0) for k, p in enumerate(patterns)])
    rows = docs.select(*carry, text.alias("body"), F.monotonically_increasing_id().alias("row"))
    return settle(rows.withColumn("hits", found).drop("body"))


def _spans(scanned: DataFrame) -> DataFrame:
    """``row, spans`` of the rows that have some."""
    single = scanned.where(F.size("hits") > 0).select("row", F.inline("hits"))
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = single.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size")).where("sound")
    linked = _linked(placed.select("row", "kind", "start", "end"))
    return linked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _linked(parts: DataFrame) -> DataFrame:
    """Base spans, and the weak ones whose complement is within reach."""
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    kind, base = F.col("kind"), F.col("kind") < len(BASE)

    def near(wanted: Column) -> Column:
        last = F.max(F.when(wanted, F.col("end"))).over(before)
        following = F.min(F.when(wanted, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= REACH, F.lit(False)) | F.coalesce(following - F.col("end") <= REACH, F.lit(False))

    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    known = parts.withColumn("covered", ~base & covered)
    has_name = near(kind.isin(1, 3) & ~F.col("covered"))
    has_secret = near(kind.isin(0, 2, 4) & ~F.col("covered"))
    near_parts = known.withColumns({"has_name": has_name, "has_secret": has_secret})
    weak = ((kind == 4) & F.col("has_name")) | ((kind == 3) & F.col("has_secret")) | ((kind == 5) & F.col("has_name") & F.col("has_secret"))
    return near_parts.where(base | (~F.col("covered") & weak)).select("row", "kind", "start", "end")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


#: Stands in a text for a secret.
MARK = "[secret]"


def masked(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with every found span of ``text`` replaced by ``MARK``; other columns stay, ``n_chars`` follows the text.

    Overlapping spans are replaced as one. The rows are numbered as they are scanned; those without a
    hit are passed on as they are, only the others meet their spans. Repeated rows and rows without
    an id are rows like others; an empty table stays empty.
    """
    scanned = _scanned(docs, [F.struct(*docs.columns).alias("whole")])
    untouched = scanned.where(F.size("hits") == 0).select("whole.*")
    touched = scanned.where(F.size("hits") > 0).join(_spans(scanned), "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("whole.text")).otherwise(_without(F.col("whole.text"), F.col("spans")))
    fresh = touched.select("whole", text.alias("body"))
    new = {"text": F.col("body")} | ({"n_chars": F.length("body").cast("long")} if "n_chars" in docs.columns else {})
    return untouched.unionByName(fresh.select(*[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns]))


def _without(text: Column, spans: Column) -> Column:
    """``text`` with the spans (ordered by start) marked: the stretches between them, joined by the mark."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        new = span["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.concat(done["out"], gap, F.when(new, F.lit(MARK)).otherwise(F.lit(""))).alias("out"),
        )

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
