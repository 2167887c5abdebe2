"""Main text of web pages by differencing pages with near URLs.

A page's lines are its blocks of text. Within a host, pages are put in the order of their
paths; a page is paired with the page in front of or behind the run of copies it is in, whichever
path shares the longer start, their lines are aligned by longest common subsequence, and lines
that both have are page furniture.
They are deleted, unless the page marks them as its article: one element that has at least half
of the letters not marked as furniture. Several such elements, or a small one, may be teasers, and
settle nothing. What elements mark as menus, adverts and the like goes too, shared or not: such
lines differ from page to page here, so differencing alone can't find them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.stored import stored

FURNITURE, OPEN, MAIN = 0, 1, 2
# Elements whose content is no text, or no part of an article.
HIDDEN = frozenset(
    "script style noscript template iframe object svg math canvas select datalist audio video title textarea".split()
)
ASIDE = frozenset("nav footer aside form button menu dialog".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
NAMED = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|cookies?|consent|notice|comments?|disqus|sidebar|menu|navbar|navigation|"
    r"breadcrumbs?|promo\w*|sponsor\w*|share|sharing|social|related|newsletter|subscribe|popup|modal|footer|"
    r"masthead)(?:$|[_-])"
)
# Names that tell what a page has, not what the element is.
STATE = re.compile(r"(?:has|no|not|with|without|is)[_-]|.*[_-](?:enabled|disabled|open|closed|on|off)$")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# A comment, the content of a raw element's tag, a tag, or text.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|title|textarea|noscript|iframe)\b[^>]*>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|<[!?][^>]*>?|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE
)
COPY_SHARE = 0.9  # of the letters not marked as furniture, from which on a page is another's copy


def set_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is page furniture by its name, class, id or role."""
    if name in ASIDE or name == "header" and not in_article:
        return True
    if not attributes or name in ("body", "html", "main", "article"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and any(NAMED.search(v) and not STATE.match(v) for v in value.split()):
            return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order: text with single blanks, and what it is marked as.

    Blocks in the page's only outermost article or main element are ``MAIN`` if they have as many
    letters as all others not set aside, which are furniture then. Else all blocks not set
    aside are ``OPEN``. A tag that is cut off at the end is no text.
    """
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set aside, in an article
    away = article = False
    elements, of_block = 0, []  # outermost articles so far, and that of each block in one

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, FURNITURE if away else MAIN if article else OPEN))
                if article and not away:
                    of_block.append(elements)
            parts.clear()

    for raw, closing, name, attributes, text in TOKEN.findall(page or ""):
        if text:
            parts.append(text)
            continue
        if raw or not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end_block()
        if closing:
            if any(s[0] == name for s in stack):
                while stack and stack.pop()[0] != name:
                    pass
                away, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            stack.pop()  # its end tag may be left out
            away, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        hides = name in HIDDEN or set_aside(name, attributes, article)
        if hides and name in INLINE:
            end_block()
        elements += name in ARTICLE and not article
        away, article = away or hides, article or name in ARTICLE
        stack.append((name, away, article))
    end_block()
    inside, outside = (sum(len(t) for t, kind in blocks if kind == k) for k in (MAIN, OPEN))
    if len(set(of_block)) > 1 or inside < outside:
        return [(t, OPEN if kind == MAIN else kind) for t, kind in blocks]
    if inside:
        return [(t, kind if kind == MAIN else FURNITURE) for t, kind in blocks]
    return blocks


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which items of ``a`` are in a longest common subsequence with ``b``, by bit-parallel rows."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    inner_a, inner_b = a[start : len(a) - end], b[start : len(b) - end]
    places: dict[int, int] = {}
    for j, value in enumerate(inner_b):
        places[value] = places.get(value, 0) | 1 << j
    full = (1 << len(inner_b)) - 1
    rows, row = [], full
    for value in inner_a:
        met = row & places.get(value, 0)
        row = (row + met | row - met) & full
        rows.append(row)
    common = [False] * len(inner_a)
    i, j = len(inner_a), len(inner_b)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] & bit:
                common[i] = True
                j -= 1
    return [True] * start + common + [True] * end


def _common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def parsed(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """id, url, host, path and lines (text, kind) of each page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())]))
        for batch in pieces(batches):
            hosts, paths, lines = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                try:
                    split = urlsplit(url or "")
                    hosts.append(split.netloc.lower())
                    paths.append(split.path)
                except ValueError:
                    hosts.append(url)
                    paths.append("")
                lines.append([{"text": t, "kind": k} for t, k in lines_of(page)])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "url")],
                    pa.array(hosts, pa.string()),
                    pa.array(paths, pa.string()),
                    pa.array(lines, kind),
                ],
                names=["id", "url", "host", "path", "lines"],
            )

    kind = pages.schema[id_column].dataType.simpleString()
    return in_small_batches(pages).select(
        F.col(id_column).alias("id"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
    ).mapInArrow(
        parse,
        f"id {kind}, url string, host string, path string, lines array<struct<text: string, kind: int>>",
    )


def line_class() -> Column:
    """The digest of a page's lines; pages of one host that have the same are copies."""
    return F.xxhash64(F.transform("lines", lambda x: F.xxhash64(x["text"], x["kind"])))


PAGE = "host string, class long, path string, hashes array<long>, letters array<int>"


def shared_share(page: dict, other: dict) -> tuple[float, list[bool]]:
    """The share of a page's letters outside of furniture that another has too, and which lines."""
    found = shared_lines(page["hashes"], other["hashes"])
    letters = [abs(n) for n in page["letters"]]
    return sum(n for n, s in zip(letters, found) if s) / max(1, sum(letters)), found


def are_copies(a: dict, b: dict) -> bool:
    """Whether two pages of a host have nearly all letters outside of furniture in common."""
    return a["host"] == b["host"] and shared_share(a, b)[0] >= COPY_SHARE and shared_share(b, a)[0] >= COPY_SHARE


def furniture_mask(page: dict, before: dict | None, after: dict | None) -> list[bool] | None:
    """The lines a page shares with the nearer of its neighbours, if an open one is among them.

    ``before`` and ``after`` are the pages beside its run of copies; one of another host, or that
    has nearly all of the page too, tells nothing.
    """
    if not any(n < 0 for n in page["letters"]):
        return None
    near = []
    for other in (before, after):
        if other and other["host"] == page["host"]:
            share, mask = shared_share(page, other)
            if share < COPY_SHARE:
                near.append((_common_start(other["path"], page["path"]), mask))
    if not near:
        return None
    mask = max(near, key=lambda x: x[0])[1]
    return mask if any(s and n < 0 for s, n in zip(mask, page["letters"])) else None


def runs_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the pages of a range in order, run of copies by run.

    Runs between others give masks at once. Those at the ends of the range are handed on as
    pages with ``first`` or ``last`` set, and the pages the neighbouring ranges have to know with a
    ``role``: the range's first and last page, the page behind its first run and the one in front
    of its last run. What is held is one run.
    """
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    schema = pa.schema(
        [
            ("range", pa.int32()), ("role", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()),
            ("host", pa.string()), ("class", pa.int64()), ("path", pa.string()),
            ("hashes", pa.list_(pa.int64())), ("letters", pa.list_(pa.int32())), ("shared", pa.list_(pa.bool_())),
        ]
    )
    out: list[dict] = []

    def tell(page: dict, **more) -> None:
        out.append({"range": number, **page, **more})

    def settle(run: list[dict], before: dict | None, after: dict) -> None:
        for page in run:
            if before is None:
                tell(page, first=True, last=False)
            elif mask := furniture_mask(page, before, after):
                tell({"host": page["host"], "class": page["class"]}, shared=mask)

    # The page in front of the run, and the run itself.
    before, run = None, []
    for batch in batches:
        for page in batch.to_pylist():
            if run and not are_copies(run[-1], page):
                settle(run, before, page)
                if before is None:
                    tell(page, role="behind_first")
                before, run = run[-1], []
            if not run and before is None:
                tell(page, role="first")
            run.append(page)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    for page in run:
        tell(page, first=before is None, last=True)
    if run:
        tell(run[-1], role="last")
    if before:
        tell(before, role="before_last")
    yield pa.RecordBatch.from_pylist(out, schema)


def beside_ranges(marked: DataFrame) -> DataFrame:
    """For each range the pages beside its first and its last run.

    ``left`` and ``right`` are those beyond the range: the last page of the range in front, or, where a run goes
    on over the border, the page in front of that run, however many ranges it fills. The
    windows are over one row for each range.
    """
    page = F.struct("host", "class", "path", "hashes", "letters")
    roles = ("first", "last", "behind_first", "before_last")
    ends = marked.filter("role IS NOT NULL").groupBy("range").agg(
        *[F.max(F.when(F.col("role") == role, page)).alias(role) for role in roles]
    )
    in_order = Window.orderBy("range")

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether the run at the end of the range in front goes on in this one."""
        for batch in batches:
            found = [
                bool(pair["previous"]) and are_copies(pair["previous"], pair["first"])
                for pair in batch.select(["previous", "first"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(found, pa.bool_())], names=["range", "goes_on"])

    pairs = ends.select("range", F.lag("last").over(in_order).alias("previous"), "first")
    borders = stored(pairs.mapInArrow(continued, "range int, goes_on boolean"), "borders")
    # No page at all, other than one that is not known yet.
    nothing = F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in PAGE.split(", "))])
    known = ends.join(borders, "range").withColumns(
        {
            "previous": F.coalesce(F.lag("last").over(in_order), nothing),
            "next": F.coalesce(F.lead("first").over(in_order), nothing),
            "goes_over": F.coalesce(F.lead("goes_on").over(in_order), F.lit(False)),
        }
    )
    # In front of the last run of a range, and behind its first; null where the run fills the range and goes on.
    front = F.coalesce("before_last", F.when(~F.col("goes_on"), F.col("previous")))
    behind = F.coalesce("behind_first", F.when(~F.col("goes_over"), F.col("next")))
    upto = in_order.rowsBetween(Window.unboundedPreceding, -1)
    onward = in_order.rowsBetween(1, Window.unboundedFollowing)
    return known.withColumns({"front": front, "behind": behind}).select(
        "range",
        F.when(~F.col("goes_on"), F.col("previous")).otherwise(F.last("front", ignorenulls=True).over(upto)).alias("left"),
        F.when(~F.col("goes_over"), F.col("next")).otherwise(F.first("behind", ignorenulls=True).over(onward)).alias("right"),
        "before_last",
        "behind_first",
    )


def shared_with_neighbours(lines: DataFrame) -> DataFrame:
    """For each host and class of equal pages which lines the nearest page that is no copy has too.

    Classes in which no open line is shared are left out. Only hashes and lengths of lines travel,
    once. Of equal pages the first stands for all. Pages in the order of host and path that are copies
    one of the next are a run; the neighbours of all its pages are the page in front of it and the one
    behind it. Pages are dealt out by ranges, so one host, and one run, may fill many tasks, and
    the result is the same for any ranges. Without any other page nothing is furniture.
    """
    order = ["host", "path", "class"]
    light = (
        lines.select(
            "host",
            line_class().alias("class"),
            F.struct(
                "path",
                F.transform("lines", lambda x: F.xxhash64(x["text"])).alias("hashes"),
                # Letters of a line: below zero if open, zero if furniture.
                F.transform(
                    "lines",
                    lambda x: F.when(x["kind"] == FURNITURE, 0)
                    .when(x["kind"] == OPEN, -F.length(x["text"]))
                    .otherwise(F.length(x["text"])),
                ).alias("letters"),
            ).alias("page"),
        )
        .groupBy("host", "class")
        .agg(F.min("page").alias("page"))
        .select("host", "class", "page.*")
    )
    dealt = light.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"range int, role string, first boolean, last boolean, {PAGE}, shared array<boolean>"
    marked = stored(dealt.mapInArrow(runs_of_copies, schema), "runs")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for r in batch.to_pylist():
                before = r["left"] if r["first"] else r["before_last"]
                after = r["right"] if r["last"] else r["behind_first"]
                if mask := furniture_mask(r, before, after):
                    kept.append((r["host"], r["class"], mask))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in kept], pa.string()),
                    pa.array([x[1] for x in kept], pa.int64()),
                    pa.array([x[2] for x in kept], pa.list_(pa.bool_())),
                ],
                names=["host", "class", "shared"],
            )

    inner = marked.filter("shared IS NOT NULL").select("host", "class", "shared")
    at_ends = marked.filter("first IS NOT NULL").drop("role", "shared").join(beside_ranges(marked), "range")
    return inner.union(at_ends.mapInArrow(settle, "host string, class long, shared array<boolean>"))


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """The article of each page: the id, ``url``, ``text`` and ``lines`` (what was kept), one row for each input row.

    White space in a block is one blank, and blocks are joined by one blank. A null or empty page
    has an empty text. Pages of a host with equal lines share the result. Pages
    without a host are compared with each other. A null URL is an empty one.
    """
    lines = parsed(pages, id_column, url_column, html_column)
    masks = shared_with_neighbours(lines).select(
        F.col("host").alias("of"), F.col("class").alias("of_class"), "shared"
    )
    kept = F.filter(
        "lines",
        lambda x, i: (x["kind"] == MAIN) | ((x["kind"] == OPEN) & ~F.coalesce(F.get("shared", i), F.lit(False))),
    )
    return (
        lines.withColumn("class", line_class())
        .join(masks, (F.col("host") == F.col("of")) & (F.col("class") == F.col("of_class")), "left")
        .select("id", "url", F.transform(kept, lambda x: x["text"]).alias("lines"))
        .select(
            F.col("id").alias(id_column),
            F.col("url").alias(url_column),
            F.array_join("lines", " ").alias("text"),
            "lines",
        )
    )
