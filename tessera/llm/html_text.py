"""Operator 4: main text of web pages by structure and by differencing against the page with the nearest URL.

Pages are range-partitioned and sorted by host and URL path, so a page's nearest URLs stand beside it, and a host with
many pages is spread over many tasks. A first pass writes the keys and digests of all pages, which tell the partitions' bounds and, for each, the pages
beyond its ends that it borrows as neighbours. Pages with equal lines that stand together count as one, and pages without lines as none, so a
page's neighbours are the nearest pages of its host on both sides whose lines differ, wherever partitions end. Each page is cut into text lines (blocks); elements that
are boilerplate by name, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments) give none. Inside an article or main element, names weigh less: such elements and headings are never dropped for a name; its header and what is named as a menu,
a header or social links goes only if half of its characters are in links, or it is mostly controls; adverts, notices, sidebars, reader comments and the like always go.
An element whose end tag is left out ends where HTML says, or with an ancestor. The lines of every page are aligned with those
of the neighbour whose path shares the longest prefix, by a longest common subsequence, and shared lines are deleted.
Inside an article two pages that share a line do not make it boilerplate: it is deleted only if it stands among the first or among the last
EDGES lines, headings left out, on most of the host's pages, and on PAGES of them at least; pages with equal lines count once. Pages may rightly hold the same article:
where the shared lines inside are half or more of the shorter of the two articles, by characters, the articles are copies
and their lines stay. A page whose every line is shared is a copy, about which differencing says nothing: it keeps its lines.
Without a neighbour, structure alone decides: the article, if it is half or more of the page, else all lines.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*+)|<(script|style|noscript|iframe|textarea)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S | re.I,
)
#: Elements whose content is no markup, by their end tags.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "iframe", "textarea")}
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_DROP = frozenset("nav header footer aside form dialog menu head title template svg math object select button canvas audio video".split())
_HEAD = frozenset("head title meta link base template".split())
_CELLS = frozenset(("td", "th", "caption"))
_ROWS = _CELLS | {"tr", "colgroup"}
_PARTS = _ROWS | {"tbody", "thead", "tfoot"}
_TABLE = _CELLS | {"table"}
#: What a start tag ends, and within what: the end tags that HTML lets a page leave out.
_P = frozenset(("p",)), _CELLS | {"table", "button", "object", "template"}
_ENDS = (
    {"li": (frozenset(("li",)), _BLOCKS - {"address", "div", "p", "li"} | _CELLS)}
    | dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), _BLOCKS - {"address", "div", "p", "dd", "dt"} | _CELLS))
    | dict.fromkeys(("td", "th"), (_CELLS, frozenset(("table", "tr"))))
    | {"tr": (_ROWS, frozenset(("table", "tbody", "thead", "tfoot")))}
    | dict.fromkeys(("tbody", "thead", "tfoot"), (_PARTS, frozenset(("table",))))
)
_NOT_IN_P = _BLOCKS - {"body", "html", "caption", "title"} - _PARTS
_SPECIAL = _BLOCKS | _PARTS | _DROP
#: Open elements beyond this depth take the place of the last one, as in browsers.
DEPTH = 512
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
#: Names (class, id) of what is no main text, and the words that may follow one in a name: social-links, but not social-science.
_NAMES = "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies notice consent gdpr sidebar side-bar nav navbar navigation menu header footer masthead breadcrumb breadcrumbs comment comments commentlist respond share sharing social related newsletter subscribe popup modal overlay pagination pager"
_PARTS_OF = "area articles banner bar block body box button buttons center column container content count desktop dialog footer form group header icons inner item items left link links list main message mobile module nav notice outer overlay panel policy popup post posts primary right row secondary section sidebar signup slot space stories text thread tools top bottom unit warning widget widgets wrap wrapper"
_SITE = "top site main page global user reader"
#: Names that an element inside an article is dropped for whatever it holds.
_STRONG_NAMES = "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies notice consent gdpr sidebar side-bar comment comments commentlist respond newsletter subscribe popup modal overlay"
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("form button input select".split())
#: Lines at either end of an article that may be at a fixed place, and the fewest pages that show it.
EDGES, PAGES = 4, 8
#: Characters of text that a control weighs as many as.
CONTROL_CHARS = 60
_BOILER, _STRONG = (
    re.compile(rf"(?:(?:{'|'.join(_SITE.split())})[-_]?)?(?:{'|'.join(names.split())})(?:[-_]+(?:{'|'.join((_NAMES + ' ' + _PARTS_OF).split())}|[0-9]+|[0-9]+x[0-9]+))*", re.I)
    for names in (_NAMES, _STRONG_NAMES)
)
KEEP, DROP, IF_DENSE = 0, 1, 2


def _boilerplate(name: str, attributes: str, within: bool) -> int:
    """Whether an element is dropped; within says that it is inside an article."""
    if name in _DROP:
        return IF_DENSE if within and name == "header" else DROP
    if not attributes or name in ("body", "html"):
        return KEEP
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return DROP
        if key in ("class", "id") and name not in _MAIN and not (within and name in _HEADINGS):
            names = [x for x in value.split() if _BOILER.fullmatch(x)]
            if names:
                return DROP if not within or any(_STRONG.fullmatch(x) for x in names) else IF_DENSE
    return KEEP


def _tokens(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags and comments, and where what belongs to them ends. A script or style without an end tag goes on to the page's end, as
    in browsers; other elements without markup that are not ended, or are closed in themselves, are empty."""
    at, open_ = 0, set()
    while m := _TOKEN.search(page, at):
        at = m.end()
        name = (m[1] or "").lower()
        if name and not (m[0].endswith("/>") and name not in ("script", "style")):
            end = None if name in open_ else _RAW[name].search(page, at)
            if end:
                at = end.end()
            else:
                open_.add(name)
                at = len(page) if name in ("script", "style") else at
        yield m, at


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """The lines in their order, boilerplate elements left out, and which of them are inside an article or main element (1; 2 if it is a heading)."""
    out: list[str] = []
    inside: list[int] = []
    text: list[str] = []
    main = skip = at = links = heads = chars = linked = controls = 0
    opened: list[tuple[str, bool, bool, tuple[int, int, int, int] | None]] = []

    def flush() -> None:
        if text and (line := " ".join(html.unescape("".join(text)).split())):
            out.append(line)
            inside.append((2 if heads else 1) if main else 0)
        text.clear()

    def take(part: str) -> None:
        nonlocal chars, linked
        text.append(part)
        n = len(part) if not part.isspace() else 0
        chars, linked = chars + n, linked + (n if links else 0)

    def left(i: int) -> None:
        """Take the element at i from the open ones; what is named as boilerplate loses its lines if it is dense."""
        nonlocal main, skip, links, heads
        name, dropped, article, began = opened.pop(i)
        skip, main, links, heads = skip - dropped, main - article, links - (name == "a"), heads - (name in _HEADINGS)
        if began:
            first, c, x, k = began
            if 2 * (linked - x) >= chars - c or CONTROL_CHARS * (controls - k) >= chars - c:
                del out[first:], inside[first:]

    def close_to(depth: int) -> None:
        while len(opened) > depth:
            if opened[-1][2] or opened[-1][3]:
                flush()
            left(len(opened) - 1)

    def end(names: frozenset[str], within: frozenset[str]) -> None:
        """Close the open elements of these names, not looking beyond an element of within."""
        found = None
        for i in range(len(opened) - 1, -1, -1):
            if opened[i][0] in names:
                found = i
            elif opened[i][0] in within:
                break
        if found is not None:
            close_to(found)

    def end_tag(name: str) -> None:
        if name in ("body", "html"):
            return
        far = name in _PARTS or name in _MAIN or name == "table"
        for i in range(len(opened) - 1, -1, -1):
            if opened[i][0] == name:
                if name in _SPECIAL:
                    close_to(i)
                else:  # as <b> in <b><p></b>, which leaves the paragraph open
                    if opened[i][3]:
                        flush()
                    left(i)
                return
            if not far and opened[i][0] in _TABLE:
                return

    page = page or ""
    for m, ends in _tokens(page):
        if m.start() > at:
            if opened and opened[-1][0] == "head" and not page[at : m.start()].isspace():
                close_to(len(opened) - 1)
            if not skip:
                take(page[at : m.start()])
        at = ends
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        attributes = m[4] or m[7] or ""
        controls += name in _CONTROLS and (m[2] or m[5]) != "/"
        if name in _BLOCKS:
            flush()
        elif name in ("br", "td", "th") and not skip:
            text.append(" ")
        if (m[2] or m[5]) == "/":
            end_tag(name)
            continue
        if opened and opened[-1][0] == "title":
            close_to(len(opened) - 1)
        if opened and opened[-1][0] == "head" and name not in _HEAD:
            close_to(len(opened) - 1)
        if skip and name in _BLOCKS:  # a block in a drawing or formula ends it
            names = {x[0] for x in opened}
            if names & {"svg", "math"} and not names & {"foreignobject", "annotation-xml"} and name != "title":
                end(frozenset(("svg", "math")), frozenset())
        if name in _NOT_IN_P:
            end(*_P)
        if name in _ENDS:
            end(*_ENDS[name])
        if name in _VOID or attributes.endswith("/") or name in ("body", "html"):
            continue
        how = _boilerplate(name, attributes, main > 0)
        if how:
            flush()
        if len(opened) >= DEPTH:
            close_to(DEPTH - 1)
        opened.append((name, how == DROP, name in _MAIN, (len(out), chars, linked, controls) if how == IF_DENSE and not skip else None))
        skip, main, links, heads = skip + (how == DROP), main + (name in _MAIN), links + (name == "a"), heads + (name in _HEADINGS)
    if opened and opened[-1][0] == "head":
        close_to(len(opened) - 1)
    if not skip:
        take(page[at:])
    flush()
    close_to(0)
    return out, inside


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indexes of a's lines in a longest common subsequence with b; bit-parallel, one machine word for many lines."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = set(range(low)) | set(range(len(a) - high, len(a)))
    a_, b_ = a[low : len(a) - high], b[low : len(b) - high]
    where: dict[str, int] = {}
    for j, x in enumerate(b_):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b_)) - 1
    row, rows = full, [full]
    for x in a_:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j = len(a_), len(b_)
    while i and j:  # a zero bit: one more line in common up to here
        if a_[i - 1] == b_[j - 1] and not rows[i] >> (j - 1) & 1 and rows[i - 1] >> (j - 1) & 1:
            out.add(low + i - 1)
            i, j = i - 1, j - 1
        elif not rows[i] >> (j - 1) & 1 and not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out


def _size(page: tuple[list[str], list[int]], of: Iterable[int] | None = None) -> int:
    """Characters of the lines inside, of all or those given."""
    return sum(len(page[0][i]) for i in (range(len(page[0])) if of is None else of) if page[1][i])


def places(page: tuple[list[str], list[int]]) -> list[tuple[int, int]]:
    """The lines at the ends of the article, headings left out: their indexes, and digests of end and line."""
    own = [i for i, x in enumerate(page[1]) if x == 1]
    told = [(i, f"^{page[0][i]}") for i in own[:EDGES]] + [(i, f"${page[0][i]}") for i in own[-EDGES:]]
    return [(i, int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)) for i, x in told]


def kept(page: tuple[list[str], list[int]], other: tuple[list[str], list[int]] | None, fixed: frozenset[int] = frozenset()) -> list[str]:
    """The lines of a page that are its main text, seen beside its neighbour; fixed has the digests of the host's lines at fixed places."""
    text, inside = page
    article = _size(page)
    if other is None:
        return [x for x, i in zip(text, inside, strict=True) if i or 2 * article < sum(map(len, text))]
    gone = shared(text, other[0])
    back = _size(other)
    if not fixed or article and 2 * _size(page, gone) >= min(article, back or article):
        gone = {i for i in gone if not inside[i]}
    else:
        stands = {i for i, x in places(page) if x in fixed}
        gone = {i for i in gone if not inside[i] or i in stands}
    return text if len(gone) == len(text) else [x for i, x in enumerate(text) if i not in gone]


_KEYS = ["host", "path", "page_id", "sig"]
_LINED = "part int, own boolean, host string, path string, page_id long, sig long, url string, lines array<string>, inside array<tinyint>, fixed array<long>"


def _key(host: str, path: str, page_id: int | None, sig: int) -> tuple:
    """Ordered as Spark orders the columns: strings by UTF-8 are by code point, nulls come first."""
    return host, path, page_id is not None, page_id or 0, sig


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """page_id, url, host, path, lines, inside, sig of each page; sig is a digest of its lines, 0 for a page without lines."""
    for batch in batches:
        for page_id, url, page, host, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text, inside = lines(page)
            told = hashlib.blake2b("\n".join(f"{i:d}{x}" for x, i in zip(text, inside, strict=True)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            yield page_id, url, host, path, text, inside, int.from_bytes(told, "big", signed=True) or 1 if text else 0


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(host, path, page_id, sig, [x for _, x in places((text, inside))]) for page_id, _, host, path, text, inside, sig in _signed([batch])]
        kinds = pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 5, kinds, strict=True)], [*_KEYS, "places"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of sorted keys: its first key and host; the first page with lines of its first host and the first after it whose
    lines differ; likewise the last ones of its last host."""
    first = last = None
    head: list[tuple] = []
    tail: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            first = first or row
            if last and last[0] != row[0]:
                tail = []
            last = row
            if not row[3]:
                continue
            if row[0] == first[0] and len(head) < 2 and (not head or head[0][3] != row[3]):
                head.append(row)
            tail = [row, *[x for x in ([tail[0]] if tail and tail[0][3] != row[3] else tail[1:])]]
    if first:
        out = [("first", *first), *(("head", *x) for x in head), *(("tail", *x) for x in tail), ("last", *last)]
        kinds = pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["what", *_KEYS])


def _borrowed(parts: list[dict[str, list[tuple]]]) -> dict[tuple, list[int]]:
    """key -> the partitions that need this page of another partition as a neighbour: the nearest on either side whose lines differ."""
    out: dict[tuple, list[int]] = {}
    for k, part in enumerate(parts):
        for step, near, far, end in ((-1, "head", "tail", "first"), (1, "tail", "head", "last")):
            host = part[end][0][0]
            j = k + step
            while part[near] and 0 <= j < len(parts):
                there = parts[j]
                if there["last" if step < 0 else "first"][0][0] != host:
                    break
                if found := next((x for x in there[far] if x[3] != part[near][0][3]), None):
                    out.setdefault(_key(*found), []).append(k)
                    break
                if there["first" if step < 0 else "last"][0][0] != host:
                    break
                j += step
    return out


def _liner(bounds: list[tuple], borrowed: dict[tuple, list[int]]):
    """Rows of _LINED: each page in its own partition, and again in those that borrow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64())
        for batch in batches:
            rows = []
            for page_id, url, host, path, text, inside, sig in _signed([batch]):
                key = _key(host, path, page_id, sig)
                rest = host, path, page_id, sig, url, text, inside, None
                rows.append((max(bisect.bisect_right(bounds, key) - 1, 0), True, *rest))
                rows.extend((k, False, *rest) for k in borrowed.get(key, ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _LINED.split(", ")])

    return run


def _teller(bounds: list[tuple]):
    """Rows of _LINED without own for the lines at fixed places (host, fixed): one for each partition that has pages of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, fixed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                k = first = max(bisect.bisect_right(bounds, (host,)) - 1, 0)
                while k == first or k < len(bounds) and bounds[k][0] <= host:
                    rows.append((k, None, host, "", None, 0, None, None, None, fixed))
                    k += 1
            kinds = pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _LINED.split(", ")])

    return run


def fixed_lines(keys: DataFrame) -> DataFrame:
    """host, fixed: digests of the lines at fixed places on most pages of a host, and on PAGES of them; keys has host, sig, places. Pages with equal lines
    count once. Each page has EDGES lines at an end, so fewer than 2 EDGES are on most pages there, and a host has fewer than 4 EDGES in all."""
    each = keys.where(F.size("places") > 0).groupBy("host", "sig").agg(F.any_value("places").alias("places"))
    seen = each.select("host", F.explode(F.array_distinct("places")).alias("x")).groupBy("host", "x").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    of = each.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(of, "host").where(2 * F.col("n") > F.col("pages")).groupBy("host").agg(F.collect_list("x").alias("fixed"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pages of sorted partitions. Pages that stand together and have equal lines are a run, held as ids; its neighbours are
    the last page of the run before and the first of the run after."""

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    fixed_of: dict[tuple, frozenset[int]] = {}  # of the host at hand and the one before

    def texts(run: list, before: tuple | None, after: tuple | None) -> Iterator[tuple]:
        (where, own), pages = run
        fixed = fixed_of.get(where, frozenset())
        near = [(path, other) for (at, path, other) in (x for x in (before, after) if x) if at == where]
        known: dict[int, str] = {}
        for path, page_id, url in pages:
            k = max(range(len(near)), key=lambda i: len(os.path.commonprefix([near[i][0], path])), default=-1)
            if k not in known:
                known[k] = "\n\n".join(kept(own, near[k][1] if near else None, fixed))
            yield page_id, url, known[k]

    def found() -> Iterator[tuple]:
        run, before = None, None
        for part, own, host, path, page_id, sig, url, text, inside, fixed in rows():
            if own is None:
                if len(fixed_of) > 1:
                    del fixed_of[next(iter(fixed_of))]
                fixed_of[part, host] = frozenset(fixed)
                continue
            if not text:
                if own:
                    yield page_id, url, ""
                continue
            if run is None or run[0] != ((part, host), (text, inside)):
                if run:
                    yield from texts(run, before, ((part, host), path, (text, inside)))
                    before = run[0][0], end, run[0][1]
                run = ((part, host), (text, inside)), []
            end = path
            if own:
                run[1].append((path, page_id, url))
        if run:
            yield from texts(run, before, None)

    def out(held: list) -> pa.RecordBatch:
        ids, urls, of = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(of, pa.string()), pa.array([len(x) for x in of], pa.int64())], ["page_id", "url", "text", "n_chars"])

    held: list = []
    for row in found():
        held.append(row)
        if len(held) >= 256:
            yield out(held)
            held = []
    if held:
        yield out(held)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null or empty html gives an empty text. A null url is a host and path of its own. Repeated rows give a row each; pages with equal lines that
    stand together have the same neighbours. Of two neighbours whose paths share as much, the one before is taken. No pages give no rows.
    Other columns of pages are not looked at.
    """
    common.small_batches(pages.sparkSession, 256)
    scratch = common.Scratch(pages.sparkSession, "pages")
    url = F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    host = F.regexp_extract(url, "^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(url, "^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = scratch.write(rows.mapInArrow(common.gives_back(_signatures), "host string, path string, page_id long, sig long, places array<long>"), "keys")
    edges = keys.select(*_KEYS).repartitionByRange(n, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_edges, "what string, host string, path string, page_id long, sig long")
    parts: dict[int, dict[str, list[tuple]]] = {}
    for r in edges.withColumn("part", F.spark_partition_id()).collect():  # at most six rows a partition
        parts.setdefault(r.part, {x: [] for x in ("first", "head", "tail", "last")})[r.what].append(tuple(r)[1:5])
    ordered = [parts[k] for k in sorted(parts)]
    bounds = [_key(*x["first"][0]) for x in ordered]
    lined = rows.mapInArrow(_liner(bounds, _borrowed(ordered)), _LINED)
    lined = lined.union(fixed_lines(keys).mapInArrow(_teller(bounds), _LINED))
    near = lined.repartitionById(n, F.col("part")).sortWithinPartitions("part", "host", F.col("own").isNotNull(), *_KEYS[1:], "own")
    return near.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
