"""Main text of web pages: structure first, then differencing of pages with neighbouring URLs."""

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from barledger.llm.common import row_mapper, settle, texts
from barledger.llm.urlglob import host, path

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)(?:>|\Z|(?=<))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|["'].*|[^\s"'>][^\s>]*))?""", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w")

#: Elements by what they do (fixed values of the format, grouped by use here).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object select textarea title canvas audio video annotation annotation-xml".split())
#: Their content is foreign: a closing slash ends them.
FOREIGN = frozenset(("svg", "annotation", "annotation-xml"))
_MATH = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose mfenced merror maction semantics annotation annotation-xml"
INLINE = frozenset((_MATH + " a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr").split())
#: Blocks of prose: a line in one belongs to the element around it.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre figcaption".split())
ASIDE = frozenset("nav footer aside form button menu dialog head fieldset".split())
MAIN = frozenset(("article", "main"))
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_PLACE = "site|page|global|top|main|side|bottom|left|right"
_ABOUT = (
    "navigation|navbar|nav|menu|header|masthead|footer|sidebar|aside|breadcrumbs?|pagination|pager"
    "|ads?|adverts?|advertisements?|advertising|sponsored|sponsor|promo|promotion|banner"
    "|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    "|share|sharing|social|related|recommended|comments?|replies|reply|discussion|disqus|respond"
)
_PART = r"bar|box|container|wrapper|wrap|list|area|section|block|form|links|widget|slot|unit|thread|\d+"
_ASIDE_NAMES = re.compile(
    rf"(?:(?:{_PLACE})[-_]?)?(?:{_ABOUT})(?:[-_]?(?:{_ABOUT}|{_PART}))*"
    r"|(?:post|article|reader|user)[-_](?:comments?|replies|discussion|ads?|share|sharing|related|nav|navigation|footer)(?:[-_](?:list|section|area|\d+))*",
    re.I,
)

#: Names that a part of an article may have as well: inside a main element these, and all ids, only raise a doubt.
_DOUBTFUL = re.compile(r"(?:article|post|entry)?[-_]?(?:header|masthead|discussion|related|recommended|notice|alert|banner|footer|social|promotion)", re.I)
_REMARK = re.compile(r"comment|reply|message|response", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO, YES, DOUBT = range(3)


@dataclass
class Page:
    lines: list[str]
    kept: list[bool]  # lines that structure leaves in the main text
    marked: bool  # there is an article or main element
    units: list[tuple[int, int]]  # for each line of the main text: the lines of it that go together with this one (first, end)


def _is_aside(name: str, attributes: str, within_main: bool) -> int:
    """Whether an element is beside the main text; ``DOUBT`` if only its content can tell. A heading's names say nothing."""
    if name in ASIDE or (name == "header" and not within_main):
        return YES
    if name in ("html", "body", "main", "header") or not attributes:
        return NO
    verdict = NO
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return YES
        if key == "role" and value.lower() in ASIDE_ROLES:
            return YES
        if key in ("class", "id") and name not in HEADINGS:
            for v in value.split():
                if _ASIDE_NAMES.fullmatch(v):
                    if not within_main or (key == "class" and not _DOUBTFUL.fullmatch(v)):
                        return YES
                    verdict = DOUBT
    return verdict


@dataclass
class _Doubt:
    """A container inside the main text whose name may mean a part of it or something beside it."""

    first: int  # its first line
    depth: int  # elements around it
    remarks: int = 0  # its children that look like comments of readers
    forms: int = 0


def parse(source: str) -> Page:
    """Text lines of the whole page, a line per block; markup, scripts and styles give none.

    Unclosed elements end with the element around them, a cut page ends all. A closing tag without
    its element does nothing.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # element, is aside, is main, holds lines
    opened: Counter[str] = Counter()  # elements on the stack
    asides = mains = 0
    lines: list[str] = []
    inside: list[tuple[bool, bool]] = []  # within an aside, within main
    holders: list[list[int]] = [[0, 0]]  # first line and end of elements that hold lines, the page first
    holding = [0]  # those that are open
    around: list[int] = []  # the innermost of each line, -1 for a line of links
    parts: list[str] = []
    linked = plain = False  # the parts have words within, and outside of, links
    marked = False
    doubts: list[_Doubt] = []  # open containers in doubt

    def end_line() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        nonlocal linked, plain
        parts.clear()
        if text:
            lines.append(text)
            inside.append((asides > 0, mains > 0))
            around.append(-1 if linked and not plain else holding[-1])
        linked = plain = False

    def add(text: str) -> None:
        nonlocal linked, plain
        parts.append(text)
        if opened["a"]:
            linked = linked or bool(_WORD.search(text))
        else:
            plain = plain or bool(_WORD.search(text))

    def settle_doubt() -> None:
        """A container that holds a form or several comments, or more lines of links than others, goes."""
        doubt = doubts.pop()
        own = [i for i in range(doubt.first, len(lines)) if not inside[i][0]]
        links = sum(around[i] < 0 for i in own)
        if doubt.forms or doubt.remarks > 1 or 2 * links > len(own):
            for i in own:
                inside[i] = (True, inside[i][1])

    def pop() -> str:
        nonlocal asides, mains
        last, aside, main, holds = stack.pop()
        if doubts and doubts[-1].depth == len(stack):
            settle_doubt()
        opened[last] -= 1
        asides -= aside
        mains -= main
        if holds:
            holders[holding.pop()][1] = len(lines)
        return last

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            add(source[at:])
            break
        if found.start() > at:
            add(source[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            end_line()
        elif name == "img":
            continue
        if found[1]:
            while opened[name]:
                if pop() == name:
                    break
            continue
        if name in RAW and not (name in FOREIGN and (found[3] or "").endswith("/")):
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = closing.end() if closing else size
            continue
        if name in VOID or (found[3] or "").endswith("/"):
            if name in ("td", "th"):
                parts.append(" ")
            continue
        verdict = _is_aside(name, found[3] or "", mains > 0)
        aside = verdict == YES
        main = name in MAIN and not asides and not aside
        if name == "p" or name == "li":  # these end their like before them
            while stack and stack[-1][0] in (name, *INLINE):
                pop()
        if doubts:
            doubts[-1].forms += name == "form"
            doubts[-1].remarks += name == "article" or (name not in INLINE and _REMARK.search(found[3] or "") is not None)
        if verdict == DOUBT:
            doubts.append(_Doubt(len(lines), len(stack)))
        marked |= main
        asides += aside
        mains += main
        holds = name not in INLINE and name not in PROSE
        if holds:
            holding.append(len(holders))
            holders.append([len(lines), 0])
        stack.append((name, aside, main, holds))
        opened[name] += 1
    end_line()
    while doubts:
        settle_doubt()
    for k in holding:
        holders[k][1] = len(lines)
    kept = [not aside and (main or not marked) for aside, main in inside]
    place = list(accumulate(kept, initial=0))  # kept lines before each line
    alone = [(place[i], place[i] + 1) for i in range(len(lines))]
    units = [alone[i] if k < 0 or not marked else (place[holders[k][0]], place[holders[k][1]]) for i, k in enumerate(around) if kept[i]]
    return Page(lines, kept, marked, units)


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64).view(np.int64)


def common_lines(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Equal ends are taken off first; between them only lines that both have count, and the longest
    increasing run of their matching places is the subsequence.
    """
    n, m = len(own), len(other)
    head = 0
    while head < min(n, m) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and own[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(m - tail - 1, head - 1, -1):
        places.setdefault(int(other[j]), []).append(j)  # from the last to the first
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(head, n - tail):
        for j in places.get(int(own[i]), ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif ends[k] != j:
                ends[k] = j
                links[k] = link
    middle = []
    link = links[-1] if links else None
    while link is not None:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(n - tail, n)]


#: Two pages that share more of their kept lines than this may be versions of one text as well as pages of one template.
CLOSE_SHARE = 0.8


def template_lines(own: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Places of lines shared with a neighbour that is not close, or with every neighbour."""
    some: set[int] = set()
    every: set[int] | None = None
    for other in others:
        places = common_lines(own, other)
        every = set(places) if every is None else every & set(places)
        if len(places) <= CLOSE_SHARE * min(len(own), len(other)):
            some.update(places)
    return sorted(some | (every or set()))


def repeated_units(own: np.ndarray, units: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Places of the lines of a marked main text that every neighbour shares with their whole units.

    A line beside own prose, in the same element, stays: articles share licence lines that are not
    template. So does everything if the only neighbour shares most lines.
    """
    first, end = units[::2], units[1::2]
    if not len(others) or not np.any((first > 0) | (end < len(own))):
        return []
    every = np.ones(len(own), dtype=bool)
    for other in others:
        places = common_lines(own, other)
        if len(others) == 1 and len(places) > CLOSE_SHARE * min(len(own), len(other)):
            return []
        shared = np.zeros(len(own), dtype=bool)
        shared[places] = True
        every &= shared
    before = np.concatenate(([0], np.cumsum(every)))
    gone = (before[end] - before[first] == end - first) & ((first > 0) | (end < len(own)))
    return np.flatnonzero(gone).tolist()


def parsed_pages(pages: DataFrame) -> DataFrame:
    """A row per page: ``row, page_id, url, host, path, lines, digest, hashes, units``.

    All are those of the text that structure keeps; units (first and end of each line's) only where an
    element marks the main text.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(t) for t in texts(rows.column(1))]
        kept = [[x for x, k in zip(p.lines, p.kept) if k] for p in found]
        hashes = [line_hashes(x) for x in kept]
        return pa.RecordBatch.from_arrays([
            rows.column(0), pa.array(kept, pa.list_(pa.string())),
            pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary()), pa.array(hashes, pa.list_(pa.int64())),
            pa.array([[x for u in p.units for x in u] if p.marked else [] for p in found], pa.list_(pa.int32())),
        ], ["head", "lines", "digest", "hashes", "units"])

    head = F.struct(F.monotonically_increasing_id().alias("row"), "page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = pages.select(head.alias("head"), F.col("html").cast("string").alias("html"))
    schema = f"head {rows.schema['head'].dataType.simpleString()}, lines array<string>, digest binary, hashes array<long>, units array<int>"
    return rows.mapInArrow(row_mapper(batch), schema).select("head.*", "lines", "digest", "hashes", "units")


def neighbours(parsed: DataFrame) -> DataFrame:
    """``host, digest, hashes, units, others``: line hashes of every different text of a host, and of the texts next to it in the order of paths.

    Pages of equal text count once, at their first path, so each meets the nearest different texts:
    one on either side, or two on one side at the ends of a host. Texts are dealt by ranges of
    (host, path), so a host of any size is spread out; each range borrows two texts from either side.
    """
    order = ["host", "path", "page_id", "row"]
    key = F.struct("path", "page_id", "row")
    classes = parsed.where("host <> '' and size(hashes) > 0").groupBy("host", "digest").agg(F.min(key).alias("key"), F.min_by(F.struct("hashes", "units"), key).alias("page"))
    dealt = classes.select("host", "key.*", "digest", "page.*").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = settle(dealt)
    page = F.struct(*order, "hashes")
    inner = Window.partitionBy("part")
    numbered = dealt.withColumn("nth", F.row_number().over(inner.orderBy(*order))).withColumn("rows", F.count(F.lit(1)).over(inner))
    ends = numbered.where("nth <= 2 or nth > rows - 2").groupBy("part").agg(
        F.array_sort(F.collect_list(F.when(F.col("nth") <= 2, page))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("nth") > F.col("rows") - 2, page))).alias("last"))
    parts = Window.orderBy("part")  # a row per range
    none = F.array().cast(ends.schema["first"].dataType)

    def joined(*several: Column) -> Column:
        return F.concat(*[F.coalesce(x, none) for x in several])

    earlier = joined(F.lag("last", 2).over(parts), F.lag("last").over(parts))  # a range may hold one text
    later = joined(F.lead("first").over(parts), F.lead("first", 2).over(parts))
    beside = ends.select("part", F.concat(F.slice(F.reverse(earlier), 1, 2), F.slice(later, 1, 2)).alias("pages"))
    borrowed = beside.select("part", F.explode("pages").alias("page")).select("part", "page.*")
    every = dealt.select("part", *order, "digest", "hashes", "units", F.lit(False).alias("lent")).union(borrowed.select("part", *order, F.lit(None), "hashes", F.lit(None), F.lit(True)))
    within = inner.orderBy(*order)

    def near(move, n: int) -> Column:
        return F.when(move(F.col("host"), n).over(within) == F.col("host"), move(F.col("hashes"), n).over(within))

    sides = {"b1": near(F.lag, 1), "b2": near(F.lag, 2), "a1": near(F.lead, 1), "a2": near(F.lead, 2)}
    two = F.when(F.col("b1").isNull(), F.array("a1", "a2")).when(F.col("a1").isNull(), F.array("b1", "b2")).otherwise(F.array("b1", "a1"))
    return every.withColumns(sides).where("not lent").select("host", "digest", "hashes", "units", F.array_compact(two).alias("others"))


def _shared(own: pd.Series, units: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([repeated_units(o, u, list(x)) if len(u) else template_lines(o, list(x)) for o, u, x in zip(own, units, others)], dtype="object")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages``: the main text of the whole html.

    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles go by
    their elements, roles, classes and ids, and by an article or main element that marks the text.
    Within it an id, or a name that a part of an article may have too (header, discussion, related),
    decides only with what it holds: a form, several comments, or more lines of links than others. Headings never go by a name.
    Then lines aligned with the neighbouring texts of the host's order of paths go. Without a marked
    text these are lines of both neighbours, or of one if the two do not share most of their lines.
    In a marked text they are lines of both neighbours that consist of links, or whose element holds
    such lines only; a shared line beside own prose stays. Pages of equal text are one neighbour and
    get equal results. A null or empty html gives an empty text, a null URL has no neighbours,
    repeated rows are rows like any other, an empty table gives no rows.
    """
    parsed = settle(parsed_pages(pages))
    shared = F.pandas_udf(_shared, "array<int>")
    near = neighbours(parsed).where(F.size("others") > 0).select("host", "digest", shared("hashes", "units", "others").alias("shared"))
    near = settle(near.where(F.size("shared") > 0))
    gone = settle(parsed.select("row", "host", "digest").join(near, ["host", "digest"]).select("row", "shared"))  # lines do not move by their text's key
    staying = F.filter("lines", lambda line, i: ~F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), i))
    return parsed.join(gone, "row", "left").select("page_id", "url", F.array_join(staying, "\n").alias("text"))
