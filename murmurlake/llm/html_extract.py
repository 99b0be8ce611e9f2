"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one for each block). What a line weighs is its text length, nothing if it is mostly links; menus, adverts,
forms and the like leave blank lines. Over sliding windows of lines weights are summed: where the sum surges from nothing the text
begins, where it dives to nothing it ends, and all lines between, light ones too, are text. So a list of links is dropped inside an article
as outside one, and a link between paragraphs stays. A page is one row; its work is linear in the html.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Za-z]+")

#: Elements whose content is no text of the page.
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select".split())
#: Elements that are never part of the article.
_ASIDE = frozenset("nav footer aside form dialog menu button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody thead tfoot tr ul caption".split())
#: Elements that hold the blocks of one text together.
_HOLDERS = frozenset("blockquote body center details div fieldset html section table".split())
_ROOT = frozenset("html body main article".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class and id names, and roles, of what surrounds an article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "subscription social share sharing related recommended recommendations sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies "
    "toolbar pagination pager outbrain taboola contentinfo complementary paywall".split()
)
#: The same, but left out only outside an article: inside one they are as often parts of the text.
_SOFT = frozenset("header topbar copyright legal disclaimer widget skip login search teaser rail".split())


def _marked(attrs: str, inside: bool) -> bool:
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role") and any(p in _NAMES or p in _SOFT and not inside for p in _PART.findall(value)):
            return True
    return False


def lines_of(page: str, by_name: bool = True) -> tuple[list[tuple[str, int, bool, int]], bool]:
    """(line, weight, inside an article, container) for each block in page order, ("", 0, False, 0) where something was left out;
    whether there is an article. The container is the innermost holder element that has further lines in it."""
    lines: list[tuple[str, int, bool, int]] = []
    text: list[str] = []
    parents, held, opened = [0], [("", 0)], Counter()
    linked = inside = pos = 0
    has_article = in_link = False
    skip, depth, until = "", 0, 0

    def end() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            words = entities.unescape(raw).split()
            if words:
                line = " ".join(words)
                lines.append((line, 0 if linked > 0.8 * len(raw.strip()) else len(line), inside > 0, held[-1][1]))
            text.clear()
        linked = 0

    n = len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else n
        if stop > pos and not skip:
            text.append(page[pos:stop])
            if in_link:
                linked += stop - pos
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if not closing and name in _RAW:
            if not attrs.endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                pos = shut.end() if shut else n if name in ("script", "style") else pos
            continue
        if skip:
            if name in ("article", "main") and not closing and not inside:
                skip = ""  # what was to be left out was never closed
            elif name in _ROOT and closing and (name in ("body", "html") or inside):
                skip = ""
            else:
                if name == skip and not attrs.endswith("/"):
                    depth += -1 if closing else 1
                    if not depth:
                        skip = ""
                continue
        if name == "br" or name in ("td", "th"):
            text.append(" ")
            continue
        if name == "a":
            in_link = not closing
            continue
        if name in _BLOCK:
            end()
        if name in ("article", "main"):
            has_article = True
            inside = max(0, inside + (-1 if closing else 1))
            lines.append(("", 0, False, 0))
        elif not closing and name not in _VOID and name not in _ROOT and name not in _HEADING and (name in _ASIDE or name == "header" and not inside or by_name and _marked(attrs, inside > 0)):
            end()
            lines.append(("", 0, False, 0))
            skip, depth = ("", 0) if attrs.endswith("/") else (name, 1)
            continue
        if name in _HOLDERS and not closing and not attrs.endswith("/"):
            parents.append(held[-1][1])
            held.append((name, len(parents) - 1))
            opened[name] += 1
        elif name in _HOLDERS and closing and opened[name]:
            last = ""
            while last != name:
                last, _ = held.pop()
                opened[last] -= 1
    end()
    within = Counter(c for x, _, _, c in lines if x)
    for c in range(len(parents) - 1, 0, -1):
        within[parents[c]] += within[c]

    def shared(c: int) -> int:
        while c and within[c] == 1:
            c = parents[c]
        return c

    return [(x, w, i, shared(c) if x else 0) for x, w, i, c in lines], has_article


def stretches_of(weights: list[int], window: int, least: int) -> list[tuple[int, int]]:
    """Ranges from a surge to the next dive: a line with weight from which `window` lines weigh `least` or more, and the first line
    after it from which they weigh nothing."""
    weights = weights + [0] * window
    found, open_at, total = [], -1, sum(weights[:window])
    for i in range(len(weights) - window):
        if open_at < 0 and weights[i] and total >= least:
            open_at = i
        elif open_at >= 0 and not total:
            found.append((open_at, i))
            open_at = -1
        total += weights[i + window] - weights[i]
    return found + ([(open_at, len(weights) - window)] if open_at >= 0 else [])


def main_text(page: str | None, window: int = 3, least: int = 80) -> str:
    """The article's blocks joined by two line ends; empty if there is none.

    Between two left-out parts stand `window` blank lines, so that the window sum falls to nothing there. Where a page has an article
    element with text, lines outside it are left out and any weight is a surge; elsewhere a surge needs `least` characters. Every
    stretch between surge and dive is kept, however long others are, and so are further lines with weight of the containers that its
    lines stand in: a left-out part inside a text does not end the text. A page whose lines are all in left-out parts by their names is
    read again without regard to names.
    """
    if not page:
        return ""
    lines, has_article = lines_of(page)
    if not any(w for _, w, *_ in lines):
        lines, has_article = lines_of(page, by_name=False)
    if has_article and any(w and i for _, w, i, _ in lines):
        lines, least = [(x, w, i, c) if i else ("", 0, i, c) for x, w, i, c in lines], 1
    spread: list[tuple[str, int, int]] = []
    for x, w, _, c in lines:
        spread += [(x, w, c)] if x else [("", 0, 0)] * window
    dense = {i for a, b in stretches_of([w for _, w, _ in spread], window, least) for i in range(a, b)}
    texts = {c for i, (_, w, c) in enumerate(spread) if w and i in dense}
    return "\n\n".join(x for i, (x, w, c) in enumerate(spread) if x and (i in dense or w and c in texts))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages to (page_id, url, text, n_chars); n_chars counts code points. Null or empty html gives an empty text.

    Each page is read whole and alone, so repeated rows give repeated results; further columns, whatever their names, are left out; null
    ids and urls stay null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
