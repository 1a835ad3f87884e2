"""HTML extraction by line-block distribution."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Lines of a window; weight (text length) from which a window counts as a surge.
WINDOW, SURGE = 3, 80

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that are never main text.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form iframe svg math button select option optgroup textarea dialog menu "
    "object canvas audio video map noembed noframes search datalist label fieldset legend".split()
)
#: Words in a class or id, and roles, that mark page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|footer|foot|sidebar|side|aside|ad|ads|adv|adsense|advert|adverts|advertisement|advertising|"
    r"sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|comment|comments|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommended|"
    r"recommendations|widget|widgets|pagination|pager|toolbar|topbar|masthead|copyright|disclaimer|legal|skip|toc|tags|hidden)(?:$|[\s_-])",
    re.I,
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply)(?:$|[\s_-])", re.I)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|head|top)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_HINTS = re.compile(r"class|id|role|hidden|style", re.I)
#: What an opening tag closes without saying so.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


#: Elements that mark the main text, whose edges set it apart; those that stray closing tags do not pass.
MARKS = frozenset("main article".split())
BARS = frozenset("article main body html".split())


@dataclass
class Line:
    text: str
    linked: int
    main: bool


BLANK = Line("", 0, False)


def _furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body") or not _HINTS.search(attributes):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if name in ("main", "article"):
        return bool(COMMENT.search(names))
    return bool(FURNITURE.search(names) or not inside and HEADERS.search(names))


def lines(page: str) -> list[Line]:
    """The lines of a page in order, markup stripped and white space made single.

    A block of text is a line. Between two blocks stand blank lines: one for each pair of further block tags there,
    and WINDOW for each edge of a marked part. Furniture has no text: nothing of it is read.
    """
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, main
    at_name: dict[str, list[int]] = {}  # places of the open elements of a name
    blocks: list[int] = []  # places of open blocks
    bars: list[int] = []  # places of open elements that stray closing tags do not pass
    text: list[str] = []
    linked = depth = tags = 0
    dropped_from = -1  # place of the element at which the dropped part begins

    def flush() -> None:
        nonlocal linked, tags
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.extend([BLANK] * ((tags - 1) // 2))
                out.append(Line(line, linked, bool(stack) and stack[-1][2]))
                tags = 0
            text.clear()
        linked = 0

    def close(k: int) -> None:
        """Closes the elements from the k-th on."""
        nonlocal depth, tags, dropped_from
        while len(stack) > k:
            name = stack.pop()[0]
            depth -= name == "a"
            tags += 2 * WINDOW * (name in MARKS and dropped_from < 0)
            if dropped_from == len(stack):
                dropped_from = -1
            at_name[name].pop()
            for places in (blocks, bars):
                if places and places[-1] == len(stack):
                    places.pop()

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and dropped_from < 0:
            piece = html.unescape(piece)
            text.append(piece)
            if depth:
                linked += len("".join(piece.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                flush()
                tags += dropped_from < 0
            open_ = at_name.get(name)
            if open_ and (name in BARS or not bars or open_[-1] >= bars[-1]):
                close(open_[-1])
            continue
        if name in BLOCKS:
            flush()
            tags += dropped_from < 0
            # page parts end what was left open before them
            if name in ("body", "main", "article") and dropped_from >= 0 and not at_name.get("main") and not at_name.get("article"):
                close(dropped_from)
            if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in CLOSES.get(name, ())):
                close(blocks[-1])
        elif name in ("br", "img", "input"):
            text.append(" ")
        if name in VOID:
            continue
        attributes = m[3] or m[6] or ""
        inside = bool(stack) and stack[-1][2]
        raw = name in RAW
        if not raw and attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        starts = dropped_from < 0 and (raw or _furniture(name, attributes, inside))
        if starts:
            flush()
            dropped_from = len(stack)
        elif name in MARKS and dropped_from < 0:
            tags += 2 * WINDOW
        at_name.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        if name in BARS or name == "table":
            bars.append(len(stack))
        dropped = dropped_from >= 0
        stack.append((name, dropped, inside if raw else not dropped and (inside or name in MARKS)))
        depth += name == "a"
        if raw:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def weights(found: list[Line]) -> tuple[list[int], float]:
    """The weight of each line, and the bar that a window has to reach.

    A line weighs its characters; one that is mostly links, outside a marked part, nothing. On a page that marks its
    article or main part, marked lines weigh more by all that is not marked, and the bar lies there. On any other the
    bar is SURGE, or half of the heaviest window where that is less than SURGE.
    """
    plain = [0 if 2 * x.linked > len(x.text) and not x.main else len(x.text) for x in found]
    if any(x.main for x in found):
        lift = 1 + sum(w for w, x in zip(plain, found) if not x.main)
        return [w + lift * x.main for w, x in zip(plain, found)], lift
    return plain, min(SURGE, max(windows(plain), default=0) / 2)


def windows(weight: list[int]) -> list[int]:
    """The sum over the WINDOW lines from each line on."""
    upto = [0, *accumulate(weight)]
    n = len(weight)
    return [upto[min(i + WINDOW, n)] - upto[i] for i in range(n)]


def stretches(weight: list[int], bar: float) -> list[tuple[int, int]]:
    """Surge and dive points: [start, end) of each stretch of lines between them.

    A stretch surges at the first line with weight whose window reaches the bar, together with the lines right above
    that have weight, and dives where a window has no weight at all.
    """
    n, sums, found, i = len(weight), windows(weight), [], 0
    while i < n:
        if weight[i] and sums[i] >= bar:
            start = end = i
            while start and weight[start - 1]:
                start -= 1
            while end < n and sums[end]:
                end += 1
            while not weight[end - 1]:
                end -= 1
            found.append((start, end))
            i = end
        i += 1
    return found


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by a line break; empty for a null, empty or textless page.

    The stretches between surge and dive points stay, with every line inside them. Where the page marks no article or
    main part, so does what lies between the first surge and the last dive.
    """
    found = lines(page) if page else []
    weight, bar = weights(found)
    spans = stretches(weight, bar)
    if spans and not any(x.main for x in found):
        spans = [(spans[0][0], spans[-1][1])]
    return "\n".join(x.text for a, b in spans for x in found[a:b] if x.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per page, row by row without a shuffle.

    Null or empty html gives an empty text. Repeated rows are extracted alike; other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    short_batches(pages.sparkSession)
    inner = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return inner.mapInArrow(run, f"page_id {inner.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
