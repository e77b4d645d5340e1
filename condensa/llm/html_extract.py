"""Main text of web pages by nearest-address page differencing.

Pages are put in order of host and path, so a page's nearest addresses are its neighbours; equal
pages side by side are one. The page's visible lines are aligned by longest common subsequence with
those of the neighbour, within ``reach`` on either side, whose path agrees longest and that isn't
nearly a copy, and lines that both share are deleted as the site's frame. Markup says what alignment
can't: navigation, headers, footers, asides, forms, notices, adverts, comments and the like go
wherever they are. A declared article (``article``, ``main`` or the like) is the page's text and
nothing beside it is: its paragraphs, headings, items and cells stay even where a neighbour quotes
them, and what stands in it outside of those goes if it is shared.

Scale: a first pass over addresses and digests alone sets ranges of (host, path, digest, id) and
finds the ``reach`` pages before and after each range, which is what reaches the driver. Pages are
then shuffled once, into their range, those at an edge into the next one too; so one host may hold
any share of them, and the text of a page doesn't depend on where ranges end. A task holds a few
pages at a time, and ids and addresses of the copies of a page.

Defined cases: null html gives an empty text; a null address is host and path of no characters.
Rows with null or repeated ids are handled each. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_pandas, partitions, table

_RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|title|xmp|noembed|noframes"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
_DROPPED = frozenset("head nav footer aside form button dialog menu audio video map applet frameset datalist fieldset".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tr td th tbody thead ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WITHIN = frozenset("ul ol dl table tbody thead tfoot div section article main body form nav aside footer header blockquote".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_FRAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|popup|modal|overlay"
    r"|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|aside|widgets?|related|recommended|recommendations|share|sharing|social|comments?|commentlist|respond|replies|reply|disqus|footer|foot|header|masthead|topbar|toolbar|pagination|pager|login|signup|search|skip|toc|tags)(?:$|[-_\s\d])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[-_\s])(?:comments?|replies|reply|respond|ads?|sponsored|related|teaser)(?:$|[-_\s\d])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_BODY = re.compile(r"(?:^|\s)(?:article-?body|article-?content|articlebody|post-?content|post-?body|entry-?content|story-?body|main-?content)(?:$|\s)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements whose text is an article's own.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre summary".split())
#: Frame; outside of an article; in one, but in no element of text; an article's text.
FRAME, PLAIN, LOOSE, ARTICLE = 0, 1, 2, 3


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) if v else "" for k, v in _ATTRIBUTE.findall(raw)}


def _zone(tag: str, raw: str, within: int) -> int:
    """What an element makes of its contents, given what it stands in."""
    if within == FRAME:
        return FRAME
    if tag in _DROPPED or (tag == "header" and within != ARTICLE):
        return FRAME
    own = _attributes(raw) if raw and not raw.isspace() else {}
    names = f"{own.get('class', '')} {own.get('id', '')}" if own else ""
    role = own.get("role", "").lower()
    if role in _ROLES or "hidden" in own or own.get("aria-hidden") == "true" or ("style" in own and _HIDDEN.search(own["style"])):
        return FRAME
    if tag in ("article", "main") or role in ("main", "article") or own.get("itemprop") == "articleBody" or _BODY.search(names):
        return FRAME if _COMMENT.search(names) else ARTICLE
    if tag not in ("html", "body") and names.strip() and _FRAME.search(names):
        return FRAME
    return within


def lines_of(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order: zone and text, character references decoded and white space joined."""
    out: list[tuple[int, str]] = []
    text: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone = PLAIN

    def flush() -> None:
        # A block is one line; what an inline element inside it marks as frame is a line of its own.
        for framed in (False, True):
            if part := [x for z, x in text if (z == FRAME) is framed]:
                line = "".join(part)
                if "&" in line:
                    line = html_lib.unescape(line)
                if line := " ".join(line.split()):
                    own = FRAME if framed else max(z for z, _ in text)
                    out.append((LOOSE if own == ARTICLE and not any(t in _TEXT for t, _ in stack) else own, line))
        text.clear()

    def pop_to(i: int) -> None:
        nonlocal zone
        del stack[i:]
        zone = stack[-1][1] if stack else PLAIN

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append((zone, page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append((zone, " "))
            continue
        inline = tag in _INLINE
        if m[2]:
            if not inline:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if inline and any(x not in _INLINE for x, _ in stack[i + 1 :]):
                        break
                    pop_to(i)
                    break
            continue
        if not inline:
            flush()
            if tag in _ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] not in _INLINE:
                        break
            if same := _SAME.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same:
                        pop_to(i)
                        break
                    if stack[i][0] in _WITHIN:
                        break
        if tag in _VOID or m[4].endswith("/") and inline:
            continue
        new = _zone(tag, m[4], zone)
        stack.append((tag, new))
        zone = new
    if at < len(page):
        text.append((zone, page[at:]))
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows and a walk back through them."""
    where: dict[str, int] = defaultdict(int)
    for j, line in enumerate(b):
        where[line] |= 1 << j
    places = [i for i, line in enumerate(a) if line in where]
    rows: list[int] = []
    mask = (1 << len(b)) - 1
    row = mask
    for i in places:
        met = row & where[a[i]]
        row = (row + met | row - met) & mask
        rows.append(row)
    out: list[int] = []
    r, j = len(rows), len(b)
    while r and j:
        if rows[r - 1] >> (j - 1) & 1:
            j -= 1
            continue
        r -= 1
        if not r or rows[r - 1] >> (j - 1) & 1:
            out.append(places[r])
            j -= 1
    return out[::-1]


def main_text(lines: list[tuple[int, str]], neighbours: list[list[tuple[int, str]]], copy: float = 0.9) -> str:
    """The page's text after differencing with the first of ``neighbours`` that isn't a copy of it."""
    declared = any(zone >= LOOSE for zone, _ in lines)
    least = LOOSE if declared else PLAIN
    shared: set[int] = set()
    # Without a line that differencing may delete there is nothing to align.
    for other in neighbours if any(zone in (least, LOOSE) for zone, _ in lines) else ():
        got = common_lines([t for _, t in lines], [t for _, t in other])
        if len(got) < copy * len(lines):
            shared.update(got)
            break
    return "\n".join(t for i, (zone, t) in enumerate(lines) if zone >= least and (zone == ARTICLE or i not in shared))


def _agreement(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_KEY = ["host", "path", "digest", "no_id", "id"]


def _key(host: str, path: str, *rest) -> tuple:
    """A key in Spark's order: text by its bytes."""
    return (host.encode(), path.encode(), *map(int, rest))


def _ranges(keys: DataFrame, n: int, reach: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The greatest key of each of at most ``n`` ranges, and the ranges that need a key from beyond their edges."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[tuple] = []
        last: list[tuple] = []
        for x in batches:
            for row in zip(*(x[c].tolist() for c in _KEY)):
                if last and (last[-1][0], last[-1][2]) == (row[0], row[2]):
                    last[-1] = row
                    continue
                last.append(row)
                del last[: -reach - 2]
                if len(first) <= reach:
                    first.append(row)
        rows = first + last
        if rows:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame(rows, columns=_KEY).assign(part=part)

    ranged = keys.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY)
    by_part: dict[int, set[tuple]] = defaultdict(set)
    for r in ranged.mapInPandas(edges, "host string, path string, digest long, no_id boolean, id long, part int").collect():
        by_part[r.part].add(_key(*r[:-1]))
    parts = [sorted(by_part[p]) for p in sorted(by_part)]
    beyond: dict[tuple, list[int]] = defaultdict(list)
    for i in range(len(parts)):
        before = (k for q in range(i - 1, -1, -1) for k in reversed(parts[q]))
        after = (k for q in range(i + 1, len(parts)) for k in parts[q])
        for others in (before, after):
            pages, last = 0, None
            for k in others:
                if (k[0], k[2]) != last:
                    pages, last = pages + 1, (k[0], k[2])
                if pages > reach + 1:
                    break
                beyond[k].append(i)
    return [p[-1] for p in parts], dict(beyond)


def _lanes(spark: SparkSession, n: int) -> list[int]:
    """Numbers that hash partitioning deals to partitions 0 to n - 1 in turn."""
    got = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    own = {r.p: r.id for r in got}
    return [own.get(p, p) for p in range(n)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", reach: int = 3, differencing: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars). Without ``differencing`` only markup decides."""
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).cast("long").isNull().alias("no_id"), F.col(url_col).cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "").alias("path"),
        F.xxhash64(html_col).alias("digest"), F.col(html_col).alias("html"),
    )
    n = partitions(spark)
    bounds, beyond = _ranges(parts.select(*_KEY), n, reach)
    lanes = _lanes(spark, n)

    @F.pandas_udf("array<long>")
    def lanes_of(host: pd.Series, path: pd.Series, digest: pd.Series, no_id: pd.Series, id: pd.Series) -> pd.Series:
        keys = [_key(*row) for row in zip(*(x.tolist() for x in (host, path, digest, no_id, id)))]
        return pd.Series([[lanes[i] for i in (min(bisect_left(bounds, k), len(bounds) - 1), *beyond.get(k, ()))] for k in keys])

    def settled(pages: list[list], i: int) -> Iterator[tuple]:
        _, host, path, digest, lines, own = pages[i]
        if own:
            around = [(-_agreement(path, x[2]), abs(j - i), j) for j in range(max(0, i - reach), min(len(pages), i + reach + 1)) if j != i and (x := pages[j])[1] == host and x[3] != digest]
            text = main_text(lines, [pages[j][4] for *_, j in sorted(around)] if differencing else [])
            for page_id, url in own:
                yield page_id, url, text, len(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "text", "n_chars"]
        # Pages of a range, equal ones side by side once: lane, host, path, digest, lines, rows that are the range's own.
        window: list[list] = []
        at = 0
        for x in batches:
            rows: list[tuple] = []
            for part, is_own, no_id, page_id, url, host, path, digest, page in zip(x.lane, x.own, x.no_id, x.id, x.url, x.host, x.path, x.digest, x.html):
                if window and window[-1][0] != part:
                    for i in range(at, len(window)):
                        rows += settled(window, i)
                    window, at = [], 0
                if not window or (window[-1][1], window[-1][3]) != (host, digest):
                    window.append([part, host, re.split(r"[/?&#=.]", path), digest, lines_of(page or ""), []])
                    if len(window) > at + reach + 1:
                        rows += settled(window, at)
                        at += 1
                        if at > reach:
                            del window[0]
                            at -= 1
                if is_own:
                    window[-1][5].append((None if no_id else page_id, url))
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})
        yield pd.DataFrame([r for i in range(at, len(window)) for r in settled(window, i)], columns=columns).astype({"page_id": "Int64"})

    placed = parts.select(*parts.columns, F.posexplode(lanes_of(*_KEY)).alias("place", "lane"))
    dealt = placed.select("lane", (F.col("place") == 0).alias("own"), *parts.columns).repartition(n, "lane").sortWithinPartitions("lane", *_KEY)
    return map_pandas(dealt, run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
