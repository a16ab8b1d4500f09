"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped into lines, one per block element in page order. A line's weight is its
characters outside of links; lines of menus, headers, footers, asides, forms, adverts,
notices and comments weigh nothing and are never kept. Weights are summed over sliding windows of
``WINDOW`` lines. Where the sums surge from nothing a region begins, and it ends where they
dive to nothing; a region is strong if one of its windows reaches ``SURGE`` characters (or
the page's largest window, if that is less).

Article and main elements are read as the page's own cut: regions do not cross their edges, and
the strong regions inside are weighed against those outside. Whichever side has
more text between surges and dives holds the main text; a teaser in an article
does not outweigh a long text beside it, and a long article outweighs what surrounds it.
Of that side the lines from the first strong region to the last are kept, with the short regions between them and
those next to them; inside articles all short regions of an article with a strong
one are kept too. Lines that are mostly links stay within a region, as any paragraph, but not at its edges outside articles.

One pass, linear in the page's length; nothing is dropped or capped otherwise.
Defined results: null or empty html, or a page without main text, gives the empty
text; unclosed and truncated tags, comments, scripts and references end with the page; an
empty table gives an empty result; rows that repeat an id or a page are judged each by its
own html; equal weights inside and outside go to the article; other columns are ignored, and
the columns ``text`` and ``n_chars`` get an underscore where the id or URL column has that name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.common import arrow_map, free

WINDOW, SURGE = 3, 60

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
#: Elements whose text is never part of the page's main text.
DROPPED = frozenset("head title nav footer aside form menu button select option textarea dialog noscript iframe object svg math canvas template audio video label input search".split())
#: Elements whose content is not markup.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class names that mark boilerplate, alone or joined by hyphens to words of GENERAL.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommend recommended recommendations share sharing social comment comments commentlist replies reply respond disqus footer masthead toolbar pagination pager "
    "hidden skip copyright disclaimer".split()
)
GENERAL = frozenset("site page global top bottom left right main primary secondary side bar box list area container wrapper wrap block section content inner item items post posts article articles link links button buttons slot unit form icons icon media header head foot text bar google policy message thread".split())
#: Roles of elements that are not main text.
ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert menu menubar toolbar form".split())
#: Identifiers that mark boilerplate, on elements that only group others.
IDS = frozenset("ad ads banner comments disqus_thread cookie-banner cookie-notice footer header menu nav navbar navigation newsletter sidebar site-footer site-header".split())
GROUPS = frozenset("div section ul ol dl table center span".split())
WHOLE = frozenset(("html", "body", "article", "main"))
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
SPACE = re.compile(r"\s+")
ARTICLE = frozenset(("article", "main"))


def _tag_end(page: str, at: int) -> int:
    """Index after the '>' that ends the tag begun at ``at``, quotes respected; the page's end if there is none."""
    i, n = at, len(page)
    close = page.find(">", i)
    if close < 0:
        return n
    quoted = page.find('"', i, close) >= 0 or page.find("'", i, close) >= 0
    if not quoted:
        return close + 1
    while i < n:
        m = QUOTE_OR_END.search(page, i)
        if not m:
            return close + 1
        c = m.group()
        if c == ">":
            return m.end()
        shut = page.find(c[-1], m.end())
        if shut < 0:
            return close + 1
        i = shut + 1
    return n


QUOTE_OR_END = re.compile(r""">|=\s*["']""")


def _noise(token: str) -> bool:
    """Whether a class name is a word for boilerplate, alone or with general words."""
    if token in NOISE:
        return True
    parts = re.split(r"[-_]+", token)
    return len(parts) > 1 and any(p in NOISE for p in parts) and all(p in NOISE or p in GENERAL or not p or p.isdigit() for p in parts)


def _boilerplate(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or "").strip().lower()
        if key == "hidden" and name not in WHOLE and value != "until-found":
            return True
        if not value:
            continue
        if key == "class" and name not in WHOLE and any(map(_noise, value.split())):
            return True
        if key == "id" and name in GROUPS and value in IDS:
            return True
        if key == "role" and name not in WHOLE and not ROLES.isdisjoint(value.split()):
            return True
        if key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, number of its article or 0, characters inside links, boilerplate) of each block in page order."""
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, article
    noise = articles = links = linked = seen = 0

    def flush() -> None:
        nonlocal linked
        if text:
            body = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if body:
                out.append((body, seen if articles else 0, min(linked, len(body)), noise > 0))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal noise, articles
        _, bad, art = stack.pop()
        noise -= bad
        articles -= art

    i, n = 0, len(page)
    while i < n:
        lt = page.find("<", i)
        if lt < 0:
            lt = n
        if lt > i:
            text.append(page[i:lt])
            if links:
                linked += lt - i
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            i = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            i = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            text.append("<")
            i = lt + 1
            continue
        name = m.group().lower()
        end = _tag_end(page, m.end())
        i = end
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name in ("br", "td", "th", "wbr"):
            text.append("" if name == "wbr" else " ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name not in BLOCKS and stack[-1][1] != stack[depth][1]:
                        flush()
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break
            continue
        attributes = page[m.end() : end - 1]
        if name in RAW:
            stop = re.compile(rf"(?i)</{name}\s*/?>?").search(page, end) if not attributes.rstrip().endswith("/") else None
            i = stop.end() if stop else n
            if name in BLOCKS:
                flush()
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "option") and stack and stack[-1][0] == name:
            pop()
        if name in BLOCKS or name in DROPPED:
            in_article = articles > 0
            bad = _boilerplate(name, attributes) or name == "header" and not in_article
            if bad and name not in BLOCKS:
                flush()
            stack.append((name, bad, name in ARTICLE))
            noise += bad
            seen += name in ARTICLE and not articles  # articles within one another are one
            articles += name in ARTICLE
        elif attributes and _boilerplate(name, attributes):
            flush()
            stack.append((name, True, False))
            noise += 1
    flush()
    return out


def regions(weights: list[int], sides: list[int]) -> list[tuple[int, int, int, int]]:
    """(first line, end line, weight, largest window) of each run of windows of one side between a surge and a dive."""
    out = []
    of: dict[int, list[tuple[int, int]]] = {}
    for i, (w, side) in enumerate(zip(weights, sides, strict=True)):
        own = of.setdefault(side, [])
        if own and sides[i - 1] != side:
            own += [(-1, 0)] * WINDOW  # the edge between sides is as wide as a window
        own.append((i, w))
    for own in of.values():
        own += [(-1, 0)] * WINDOW
        total, high, mass, first, end, quiet = 0, 0, 0, -1, 0, WINDOW
        for k, (i, w) in enumerate(own):
            total += w - (own[k - WINDOW][1] if k >= WINDOW else 0)
            if w:
                if first < 0:
                    first, high, mass = i, 0, 0
                end, mass, quiet = i + 1, mass + w, 0
            else:
                quiet += 1
            high = max(high, total)
            if first >= 0 and quiet >= WINDOW:
                out.append((first, end, mass, high))
                first = -1
    return sorted(out)


def main_text(page: str | None) -> str:
    """Lines between the surges and dives of the text's distribution, joined by newlines."""
    if not page:
        return ""
    found = lines(page)
    sides = [art for _, art, _, _ in found]
    # a line of links alone in an article is an item of a list more often than a menu
    weights = [0 if bad else max(len(body) - linked, 1 if art else 0) if linked * 2 <= len(body) or art else 0 for body, art, linked, bad in found]
    every = regions(weights, sides)
    if not every:
        return ""
    surge = min(SURGE, max(high for *_, high in every))
    strong = [high >= surge for *_, high in every]
    inside = sum(mass for (first, _, mass, _), s in zip(every, strong, strict=True) if s and sides[first])
    outside = sum(mass for (first, _, mass, _), s in zip(every, strong, strict=True) if s and not sides[first])
    kept: list[tuple[int, int]] = []
    if inside >= outside and inside:
        surged = {sides[first] for (first, *_), s in zip(every, strong, strict=True) if s and sides[first]}
        kept = [(first, end) for first, end, *_ in every if sides[first] in surged]
    else:
        own = [(first, end, s) for (first, end, *_), s in zip(every, strong, strict=True) if not sides[first]]
        high = [k for k, (*_, s) in enumerate(own) if s]
        kept = [(first, end) for first, end, _ in own[max(0, high[0] - 1) : high[-1] + 2]]
    return "\n".join(found[k][0] for first, end in kept for k in range(first, end) if sides[k] == sides[first] and not found[k][3])


def _extract(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(v.as_py()) for v in batch.column(2)]
        cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names)


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id_col, url_col, text and n_chars of every row."""
    kinds = dict(df.dtypes)
    names = [id_col, url_col, free("text", (id_col, url_col)), free("n_chars", (id_col, url_col))]
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, `{names[2]}` string, `{names[3]}` long"
    return arrow_map(df.select(F.col(id_col), F.col(url_col), F.col(html_col)), partial(_extract, names=names), schema)
