"""Main text of web pages by tree scoring.

A page becomes a tree of its elements. Every paragraph passes points for its
length and commas to its container, half of them to the next one above, and so
on; an element's points are discounted by the share of its text that lies in
links. The best element is kept, with those of its siblings that have enough
points themselves. Menus, footers, forms, adverts and the like, by tag, role or
class, pass no points and are left out, unless that would take the page's text.
All sums go up the tree once, so the time grows with the page's length alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from .common import release_memory, sliced_batches

#: Elements that start and end a block of text (fixed values of the language).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas audio video select".split())
#: What a start tag of the key closes, if it is open within the same list, row or table.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
SCOPE = frozenset("html body article section div main td th table li blockquote".split())
#: Elements that a paragraph's points go to first; paragraphs and headings themselves are none.
CONTAINERS = frozenset("html body article main section div td th li blockquote dd center figure details form aside nav footer header fieldset dialog".split())
HEADINGS = frozenset("h1 h2 h3".split())

#: Elements, roles and class names that speak against main text.
BOILERPLATE = frozenset("nav footer aside form button menu dialog search label datalist head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments disqus replies respond sharing social newsletter subscribe subscription signup login "
    "recommended footer pagination pager toolbar".split()
)
#: A class name of several words also counts if its last word is a name, or its first one before one of these.
PARTS = frozenset("list box block area section container wrapper bar buttons links form slot unit panel posts items thread content inner outer widget text message menu".split())
#: First words of class names that only describe something else.
MODIFIERS = frozenset("has is with no not without can js".split())
#: Names that count only outside of an article.
OUTER_NAMES = frozenset("header masthead topbar related share".split())

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag: a > in quotes is none.
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
SIGNS = re.compile(r"""["'>]""")
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

#: A paragraph counts from this length on; siblings are kept from this share of the best one's points on, and single paragraphs from a length on.
LEAST_CHARS, SIBLING_SHARE, SIBLING_CHARS = 25, 0.2, 80
#: Points of an article or main element besides its paragraphs'.
ARTICLE_POINTS = 3.0
#: What looks like boilerplate is kept after all if an article in it has this share of its points, or if nothing else on the page has text but headings.
ARTICLE_SHARE = 0.5
#: A list of links: so many at least, and this share of its text.
MENU_LINKS, MENU_SHARE = 3, 0.8
SLICE = 2_000_000


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for k, v in ATTR.findall(attrs):
        out.setdefault(k.lower(), v.strip("\"'").lower())
    return out


def _says(name: str, names: frozenset) -> bool:
    """Whether a class name or id is one of the names, or made with one."""
    if name in names:
        return True
    words = re.split(r"[-_]+", name)
    return len(words) > 1 and words[0] not in MODIFIERS and (words[-1] in names or (words[0] in names and words[1] in PARTS))


def suspicious(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element looks like boilerplate by its tag, role, class or id."""
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    a = _attributes(attrs)
    names = (a.get("class", "") + " " + a.get("id", "")).split()
    return a.get("role") in ROLES or any(_says(x, NAMES) or (not in_article and _says(x, OUTER_NAMES)) for x in names)


def hidden(attrs: str) -> bool:
    if not attrs:
        return False
    a = _attributes(attrs)
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")


class _TagEnds:
    """The place of the > that ends a tag, from any place on: one pass from the back over quotes and >, so broken tags cost no more than others."""

    def __init__(self, source: str, begin: int):
        self.at = [m.start() for m in SIGNS.finditer(source, begin)]
        n = len(self.at)
        self.end = [-1] * (n + 1)  # outside of quotes, before sign i
        single = double = -1  # inside of quotes, before the sign
        for i in range(n - 1, -1, -1):
            sign, after = source[self.at[i]], self.end[i + 1]
            self.end[i] = self.at[i] if sign == ">" else double if sign == '"' else single
            if sign == '"':
                double = after
            elif sign == "'":
                single = after

    def find(self, begin: int) -> int:
        return self.end[bisect_left(self.at, begin)]


def tags(source: str):
    """(start, end, closing, name, attributes) of tags and comments in order; name is empty for what is no element.

    A tag ends at the first > outside of quotes, or at the first > if its quotes
    have no end. Where no > follows, the rest is text. Each character is looked
    at a bounded number of times.
    """
    at, ends = 0, None
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            at = (yield start, at, False, "", "") or at
            continue
        m = NAME.match(source, start)
        if m:
            if ends is None:
                rest = REST.match(source, m.end())
                end = rest.end() - 1 if rest else -1
                if rest is None:
                    ends = _TagEnds(source, start)
            if ends is not None:
                end = ends.find(m.end())
            broken = end < 0
            end = source.find(">", m.end()) if broken else end
            if end < 0:
                break
            at = end + 1
            name = "" if broken and m[1] else m[2].lower()
            at = (yield start, at, bool(m[1]), name, source[m.end() : end]) or at
        elif source[start + 1 : start + 2] in ("/", "!", "?"):
            end = source.find(">", start + 2)
            if end < 0:
                break
            at = end + 1
            at = (yield start, at, False, "", "") or at
        else:
            at = start + 1
    # no > is left: only a comment that never ends may follow
    if start >= 0 and (start := source.find("<!--", start)) >= 0:
        yield start, len(source), False, "", ""


class _Page:
    """The tree of a page: parents, tags and marks of elements, and blocks of text with their elements.

    Open elements are kept by name too, so that an end tag, or a start tag that
    closes others, finds its element without a walk.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.article, self.suspect = [-1], ["html"], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, element, hidden, in a link
        self.at: dict[str, list[int]] = {}  # places in the stack by tag
        self.block_at: list[int] = []
        self.parts: list[str] = []
        self.linked = self.links = 0
        at, n, found, skip = 0, len(source), tags(source), None
        while True:
            try:
                start, end, closing, name, attrs = found.send(skip)
            except StopIteration:
                break
            if start > at:
                self.add(source[at:start])
            at, skip = end, None
            if not name:
                continue
            if closing:
                self.close(name)
            elif name in RAW and not attrs.endswith("/"):
                close = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = skip = n if close is None else source.find(">", close.start()) + 1 or n
            else:
                self.open(name, attrs)
        if at < n:
            self.add(source[at:])
        self.flush()

    def add(self, text: str) -> None:
        _, _, unseen, link = self.stack[-1]
        if not unseen:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if link:
                self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append((self.stack[-1][1], text, self.linked, self.links))
            self.parts, self.linked, self.links = [], 0, 0

    def push(self, name: str, element: int, unseen: bool, link: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.block_at.append(len(self.stack))
        self.stack.append((name, element, unseen, link))

    def pop(self, to: int) -> None:
        """Closes the elements from a place of the stack on. Text belongs to the element it stands in, so an element of its own ends a block."""
        while len(self.stack) > to:
            name, element, _, _ = self.stack[-1]
            if name in BLOCKS or element != self.stack[-2][1]:
                self.flush()
            self.stack.pop()
            self.at[name].pop()
            if name in BLOCKS:
                self.block_at.pop()

    def find(self, names, stop) -> int:
        """The place of the last open element with one of the names, if none of `stop` was opened after it; else 0."""
        last = max((p[-1] for x in names if (p := self.at.get(x))), default=0)
        return last if last and all(not (p := self.at.get(x)) or p[-1] <= last for x in stop) else 0

    def open(self, name: str, attrs: str) -> None:
        if name in VOID:
            if name == "br":
                self.add(" ")
            elif name == "hr":
                self.flush()
            return
        block = name in BLOCKS
        if block:
            if i := self.find(("p",), SCOPE):
                self.pop(i)
            if name in CLOSES and (i := self.find(*CLOSES[name])):
                self.pop(i)
        _, element, unseen, link = self.stack[-1]
        in_article = self.article[element]
        suspect = suspicious(name, attrs, in_article)
        if block or suspect:
            self.flush()  # an inline one, such as a button, is no part of the block around it
            self.parent.append(element)
            self.tag.append(name)
            self.article.append(in_article or name in ("article", "main") or (bool(attrs) and _attributes(attrs).get("role") == "main"))
            self.suspect.append(suspect)
            element = len(self.parent) - 1
        if not attrs.rstrip().endswith("/") or block or name == "a":
            self.links += name == "a"
            self.push(name, element, unseen or hidden(attrs), link or name == "a")

    def close(self, name: str) -> None:
        if name in BLOCKS:
            if places := self.at.get(name):
                self.pop(places[-1])
            else:
                self.flush()
        elif (places := self.at.get(name)) and (not self.block_at or self.block_at[-1] < places[-1]):
            self.pop(places[-1])


def points_of(text: str, least: int) -> float:
    """A paragraph's points: one, one a comma, and up to three for its length."""
    return 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= least else 0.0


def kept_blocks(page: _Page, least: int = LEAST_CHARS) -> list[str]:
    """The texts of the blocks that belong to the best element and its good siblings, in order."""
    n, parent, tag = len(page.parent), page.parent, page.tag
    points = [points_of(text, least) for _, text, _, _ in page.blocks]
    own = [e if tag[e] in CONTAINERS or parent[e] < 0 else parent[e] for e, _, _, _ in page.blocks]

    # what looks like boilerplate goes, unless it holds the page's text
    inner, clean = [0.0] * n, [0.0] * n  # all points in an element, and the text in no suspicious element within it
    biggest = [0.0] * n  # the points of the greatest article in an element
    for (e, text, _, _), p in zip(page.blocks, points, strict=True):
        inner[e] += p
        clean[e] += len(text) if page.article[e] or tag[e] not in HEADINGS else 0
    for e in range(n - 1, 0, -1):
        if tag[e] in ("article", "main") and not page.suspect[e]:
            biggest[e] = inner[e]
        up = parent[e]
        inner[up] += inner[e]
        if not page.suspect[e]:
            clean[up] += clean[e]
            biggest[up] = max(biggest[up], biggest[e])
    dropped, elsewhere = [False] * n, clean[0]
    for e in range(1, n):
        dropped[e] = dropped[parent[e]]
        if page.suspect[e] and not dropped[e]:
            held = biggest[e] >= ARTICLE_SHARE * inner[e] > 0
            dropped[e] = not held and elsewhere > 0
            if not dropped[e]:
                elsewhere += clean[e]

    chars, linked, links, score, total = [0] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n
    for (e, text, k, m), o, p in zip(page.blocks, own, points, strict=True):
        if not dropped[e]:
            chars[e] += len(text)
            linked[e] += k
            links[e] += m
            score[o] += p
            total[o] += p
    for e in range(n - 1, 0, -1):
        up = parent[e]
        chars[up] += chars[e]
        linked[up] += linked[e]
        links[up] += links[e]
        score[up] += score[e] / 2
        total[up] += total[e]
    for e in range(n):
        bonus = ARTICLE_POINTS if tag[e] in ("article", "main") and score[e] else 0.0
        free = 1 - min(1, linked[e] / chars[e]) if chars[e] else 0.0
        score[e], total[e] = (score[e] + bonus) * free, total[e] * free
    best = max(range(n), key=lambda e: (score[e], -e))
    if not score[best]:
        return [] if least <= 1 else kept_blocks(page, 1)

    kept = [False] * n
    kept[best] = True
    siblings = [e for e in range(n) if parent[e] == parent[best] and e != best and not dropped[e]] if best else []
    for k, e in enumerate(siblings):
        free = 1 - linked[e] / chars[e] if chars[e] else 0.0
        paragraph = tag[e] == "p" and chars[e] >= SIBLING_CHARS and free > 0.75
        title = tag[e] in HEADINGS and e < best and free > 0.75 and (k + 1 == len(siblings) or siblings[k + 1] > best)
        kept[e] = total[e] >= SIBLING_SHARE * total[best] > 0 or paragraph or title
    menu = [links[e] >= MENU_LINKS and linked[e] >= MENU_SHARE * chars[e] and tag[e] in ("ul", "ol", "div", "p", "table", "section") for e in range(n)]
    gone = [False] * n
    for e in range(1, n):
        kept[e] = kept[e] or kept[parent[e]]
        gone[e] = dropped[e] or gone[parent[e]] or (menu[e] and e != best)
    return [text for e, text, _, _ in page.blocks if kept[e] and not gone[e]]


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks in order, one line each. Empty for null, empty or text-free pages."""
    return "\n".join(kept_blocks(_Page(source or "")))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Pages with `text` and `n_chars` (code points) added, and `html` dropped; other columns pass through.

    A null or empty page gives an empty text. Repeated rows stay repeated and
    are treated alike; of elements with equal points the outermost, then the
    first one, is best. A long page costs its length. Columns named text or
    n_chars in the input are replaced. An empty table gives an empty table.
    """
    import pyarrow as pa

    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    base = pages.select(*keep, "html")
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in sliced_batches(batches, "html", SLICE):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)
        release_memory()

    return base.mapInArrow(run, schema)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
