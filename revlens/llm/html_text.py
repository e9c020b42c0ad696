"""HTML extraction: flat text blocks, neighbour features, a decision tree.

A page is cut into flat blocks at the edges of block-level elements.  Every
block has its word count, its link density and those of its neighbours, and
flags of where it stands (inside an article, in a container of menus or
adverts, in a heading or list).  A decision tree, trained by this module on a
small labelled table, tells main text from the rest.  The text never
depends on more than the page itself; markup, scripts, styles, forms and
comments give no block at all."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import append

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template head title iframe object embed svg math canvas form button select textarea input option datalist audio video map".split())
#: Elements with raw content: up to their end tag, whatever stands inside.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements and name parts of containers that hold no main text.
ASIDE = frozenset("nav header footer aside menu dialog".split())
NAMES = re.compile(r"""(?:^|[\s_-])(?:nav(?:bar|igation)?|menus?|breadcrumbs?|side-?bars?|footer|foot|masthead|banner|topbar|ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|promotion"""
                   r"""|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommended|widget|pagination|pager|comments?|comment-list"""
                   r"""|disqus|replies|reply|respond|reviews?-list|copyright|legal|toolbar|skip-link|search)(?=$|[\s_-])""", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)  # of a page; an article's own header holds its title
#: Elements that hold text and no blocks: inside an article only the names of adverts and notices count for them.
TEXTUAL = frozenset("p pre h1 h2 h3 h4 h5 h6".split())
ADVERT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|promotion|cookies?|consent|gdpr|newsletter|subscribe|copyright)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_TAG = (r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*>)")
#: The next piece of markup, while a marked section can still end and where none can.
PIECE, PIECE_AFTER = re.compile(r"<!\[CDATA\[.*?\]\]>|" + _TAG, re.S), re.compile(_TAG, re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")  # one after the other: a value is never read as names
SPACE = re.compile(r"\s+")
#: Opening one of these ends an open element of its group, as browsers do.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SECTION = frozenset("body article main section div nav header footer aside ul ol dl table form".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_article", "in_aside", "heading", "page_has_article")

# Small labelled table: FEATURES of a block, then 1 for main text, 0 for the rest.
LABELLED = [
    # paragraphs of an article, long and short, beside menus, headings and footers
    (80, .00, 40, .00, 60, .00, 1, 0, 0, 1, 1), (25, .00, 9, .00, 90, .05, 1, 0, 0, 1, 1), (2, .00, 70, .00, 30, .00, 1, 0, 0, 1, 1), (1, .00, 8, .00, 50, .00, 1, 0, 0, 1, 1),
    (12, .00, 0, 1.0, 80, .00, 1, 0, 1, 1, 1), (5, .00, 30, .00, 50, .00, 1, 0, 1, 1, 1), (60, .10, 20, .00, 7, .00, 1, 0, 0, 1, 1), (40, .30, 60, .00, 12, .90, 1, 0, 0, 1, 1),
    (6, .00, 5, .00, 6, .00, 1, 0, 0, 1, 1), (3, 1.0, 60, .00, 40, .00, 1, 0, 0, 1, 1), (150, .02, 0, .00, 0, .00, 1, 0, 0, 1, 1), (1, .00, 0, .00, 0, .00, 1, 0, 0, 1, 1),
    (8, .50, 40, .00, 30, .00, 1, 0, 0, 1, 1), (4, .00, 3, .00, 4, .00, 1, 0, 0, 1, 1), (30, .00, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 1),
    (2, .00, 2, 1.0, 1, 1.0, 1, 0, 0, 1, 1), (1, .00, 1, 1.0, 0, .00, 1, 0, 1, 1, 1), (20, .90, 8, .80, 9, .95, 1, 0, 0, 1, 1), (7, .00, 14, .90, 90, .00, 1, 0, 0, 1, 1),
    (30, .00, 3, 1.0, 2, 1.0, 1, 0, 0, 1, 1), (120, .00, 5, .70, 80, .00, 1, 0, 0, 1, 1), (9, .00, 100, .00, 4, 1.0, 1, 0, 0, 1, 1), (3, .00, 0, .00, 6, .60, 1, 0, 0, 1, 1),
    (14, .00, 2, .50, 0, .00, 1, 0, 0, 1, 1), (4, .50, 3, 1.0, 110, .00, 1, 0, 0, 1, 1), (1, .00, 40, .00, 1, 1.0, 1, 0, 0, 1, 1), (70, .05, 6, 1.0, 5, 1.0, 1, 0, 0, 1, 1),
    # the same words in containers of menus, adverts, notices, footers and comments, inside or outside an article
    (80, .00, 40, .00, 60, .00, 1, 1, 0, 1, 0), (25, .00, 9, .00, 90, .05, 0, 1, 0, 1, 0), (2, .00, 70, .00, 30, .00, 1, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0),
    (12, .00, 0, 1.0, 80, .00, 0, 1, 1, 1, 0), (7, .00, 30, .00, 0, .00, 0, 1, 0, 1, 0), (60, .10, 20, .00, 7, .00, 0, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 1, 0, 0, 0),
    (150, .00, 60, .00, 40, .00, 0, 1, 0, 0, 0), (30, .00, 10, .00, 10, .00, 1, 1, 0, 1, 0), (5, .00, 12, .00, 9, .00, 1, 1, 1, 1, 0), (45, .00, 6, .00, 3, 1.0, 0, 1, 0, 0, 0),
    # outside the article of a page that has one
    (9, .00, 60, .00, 20, .00, 0, 0, 0, 1, 0), (40, .00, 30, .00, 40, .00, 0, 0, 0, 1, 0), (2, 1.0, 2, 1.0, 30, .00, 0, 0, 0, 1, 0), (100, .00, 5, 1.0, 9, .00, 0, 0, 0, 1, 0),
    (6, .00, 0, .00, 12, .00, 0, 0, 1, 1, 0), (1, .00, 80, .00, 0, .00, 0, 0, 0, 1, 0),
    (15, .00, 90, .00, 20, .00, 0, 0, 0, 1, 0), (25, .00, 40, .00, 60, .00, 0, 0, 0, 1, 0), (5, .00, 20, .00, 30, .00, 0, 0, 0, 1, 0), (60, .00, 70, .00, 50, .00, 0, 0, 0, 1, 0),
    # pages without an article element: long blocks with few links, and what stands between them
    (80, .00, 40, .00, 60, .00, 0, 0, 0, 0, 1), (25, .00, 9, .00, 90, .05, 0, 0, 0, 0, 1), (60, .20, 20, .00, 7, .00, 0, 0, 0, 0, 1), (18, .00, 60, .00, 40, .00, 0, 0, 0, 0, 1),
    (5, .00, 50, .00, 70, .00, 0, 0, 0, 0, 1), (7, .00, 0, 1.0, 60, .00, 0, 0, 1, 0, 1), (4, .00, 30, .00, 50, .00, 0, 0, 1, 0, 1), (150, .02, 0, .00, 0, .00, 0, 0, 0, 0, 1),
    (2, .00, 40, .00, 30, .00, 0, 0, 0, 0, 1), (4, .00, 22, .00, 18, .00, 0, 0, 0, 0, 1), (6, .00, 30, .00, 25, .10, 0, 0, 0, 0, 1), (3, .00, 15, .00, 60, .00, 0, 0, 0, 0, 1),
    (8, .00, 18, .00, 40, .00, 0, 0, 0, 0, 1), (5, .00, 60, .00, 16, .00, 0, 0, 0, 0, 1), (9, .00, 45, .00, 0, .00, 0, 0, 0, 0, 0), (5, .00, 12, .80, 10, .90, 0, 0, 0, 0, 0),
    (12, .10, 45, .00, 2, 1.0, 0, 0, 0, 0, 1), (30, .00, 0, .00, 0, .00, 0, 0, 0, 0, 1), (16, .00, 14, .00, 15, .00, 0, 0, 0, 0, 1),
    (200, .00, 150, .00, 100, .00, 0, 0, 0, 0, 1), (400, .00, 30, .00, 20, .00, 0, 0, 0, 0, 1), (130, .00, 90, .00, 200, .00, 0, 0, 0, 0, 1), (250, .05, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    # asides of such pages, of any length
    (20, .00, 30, .00, 40, .00, 0, 1, 0, 0, 0), (60, .00, 80, .00, 30, .00, 0, 1, 0, 0, 0), (100, .00, 20, .00, 60, .00, 0, 1, 0, 0, 0), (35, .00, 0, .00, 25, .00, 0, 1, 0, 0, 0),
    (18, .00, 50, .00, 90, .00, 0, 1, 0, 0, 0), (90, .10, 40, .00, 15, .00, 0, 1, 0, 0, 0), (200, .00, 100, .00, 100, .00, 0, 1, 0, 0, 0), (12, .00, 40, .00, 16, .00, 0, 1, 0, 0, 0),
    # links and what stands between them
    (2, 1.0, 2, 1.0, 60, .00, 0, 0, 0, 0, 0), (5, .80, 4, 1.0, 90, .00, 0, 0, 0, 0, 0), (3, 1.0, 1, 1.0, 40, .05, 0, 0, 0, 0, 0), (6, .60, 0, .00, 120, .00, 0, 0, 0, 0, 0),
    (10, .90, 9, .90, 35, .00, 0, 0, 0, 0, 0), (4, 1.0, 80, .00, 50, .00, 0, 0, 0, 0, 0), (2, 1.0, 0, .00, 25, .00, 0, 0, 0, 0, 0), (8, .70, 6, 1.0, 150, .00, 0, 0, 0, 0, 0),
    (40, .70, 50, .00, 60, .00, 0, 0, 0, 0, 0), (20, 1.0, 3, 1.0, 70, .00, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (1, .00, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (12, .90, 14, .80, 9, .95, 0, 0, 0, 0, 0), (30, .80, 25, .90, 6, 1.0, 0, 0, 0, 0, 0),
    (2, .00, 0, .00, 3, 1.0, 0, 0, 0, 0, 0), (4, .00, 3, 1.0, 0, .00, 0, 0, 0, 0, 0), (6, .50, 5, 1.0, 4, .70, 0, 0, 0, 0, 0), (15, .60, 60, .00, 8, 1.0, 0, 0, 0, 0, 0),
    (5, .00, 4, .60, 3, .50, 0, 0, 0, 0, 0), (3, .70, 70, .00, 2, 1.0, 0, 0, 0, 0, 0),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A decision tree by Gini impurity: a share of label 1, or (feature, limit, at most, above)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (a, b))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(limit), low)
    if best is None:
        return float(y.mean())
    _, f, limit, low = best
    return f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(maxsize=1)
def trained():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def decide(tree, row) -> bool:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree >= 0.5


def is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds no main text, by its kind, names, role or hidden state."""
    if tag in ASIDE and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and ((ADVERT if in_article and tag in TEXTUAL else NAMES).search(value) or not in_article and HEADER.search(value)):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[dict]:
    """Flat text blocks of a page in order: text, words, linked words, and where they stand."""
    out: list[dict] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # tag, skipped, aside, article, heading, link
    places: dict[str, list[int]] = {}  # of the open elements of each kind in the stack
    sections: list[int] = []  # of the open sections
    text: list[tuple[str, bool]] = []
    state = (False, False, False, False, False)

    def flush():
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
            if whole:
                linked = sum(len(html.unescape(t).split()) for t, link in text if link)
                n = len(whole.split())
                out.append({"text": whole, "words": n, "links": min(linked, n), "aside": state[1], "article": state[2], "heading": state[3]})
            text.clear()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def pop_to(k: int):
        nonlocal state
        if any(entry[0] not in INLINE for entry in stack[k:]):
            flush()
        for entry in stack[k:]:
            places[entry[0]].pop()
        del stack[k:]
        while sections and sections[-1] >= k:
            sections.pop()
        state = stack[-1][1:] if stack else (False, False, False, False, False)

    at, size = 0, len(page)
    last_tag, last_marked = page.rfind(">"), page.rfind("]]>")
    while at < size:
        m = (PIECE if at <= last_marked else PIECE_AFTER).search(page, at) if at <= last_tag or page.find("<!--", at) >= 0 else None
        if (m.start() if m else size) > at and not state[0]:
            text.append((page[at:m.start() if m else size], state[4]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and m[0].endswith("]]>") and not state[0]:
                text.append((html.escape(m[0][9:-3]), state[4]))
            continue
        tag, closing, attributes = m[2].lower(), m[1], m[3][:-1]
        section = sections[-1] if sections else -1
        if closing:
            k = innermost((tag,))
            if k >= 0 and (k >= section or tag in SECTION):
                pop_to(k)
            elif k < 0 and (section < 0 or tag in SECTION) and tag not in INLINE:
                flush()  # a stray end tag does not close its container
            continue
        if tag not in INLINE:
            flush()
            k = innermost((*CLOSES.get(tag, ()), *(("p",) if tag in ENDS_P else ())))
            if k > max(section, innermost(("blockquote",))):
                pop_to(k)
        if tag in VOID:
            continue
        if attributes.rstrip().endswith("/") and tag not in INLINE and tag not in SECTION and tag not in RAW and tag != "p":
            continue
        skipped, aside, article, heading, link = state
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        main = tag in ("article", "main") or any(n.lower() == "role" and v.strip("\"'").lower() in ("main", "article") for n, v in ATTRIBUTE.findall(attributes))
        places.setdefault(tag, []).append(len(stack))
        if tag in SECTION:
            sections.append(len(stack))
        stack.append((tag, skipped or tag in SKIPPED, aside or is_aside(tag, attributes, article), article or main,
                      heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), link or tag == "a"))
        state = stack[-1][1:]
    flush()
    return out


def main_text(page: str) -> str:
    """The main text of a page: its blocks that the tree takes, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    has = any(b["article"] for b in found)
    density = [b["links"] / b["words"] for b in found]
    kept = []
    for i, b in enumerate(found):
        before, after = i - 1, i + 1
        row = (b["words"], density[i], found[before]["words"] if i else 0, density[before] if i else 0.0,
               found[after]["words"] if after < len(found) else 0, density[after] if after < len(found) else 0.0,
               b["article"], b["aside"], b["heading"], has)
        if decide(trained(), row):
            kept.append(b["text"])
    return " ".join(kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``df``.

    Null and empty pages give an empty text, as do pages without main text;
    repeated rows repeat their result; other columns are ignored; an empty table
    gives an empty result.  The work on a page grows with its length, however broken its markup."""
    narrow = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = append(narrow, "html", "__text string", lambda pages: [pa.array([main_text(p) for p in pages], pa.string())])
    return out.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
