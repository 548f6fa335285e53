"""Operator 7: main-text extraction by scoring the trees of web pages."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.text import slices

_NOTE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_START = re.compile(r"<(/?)([a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]|\Z")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: A raw element ends at its own end tag only.
_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of these kinds closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("td", "th", "button", "table")}
JUNK_TAGS = frozenset("nav footer aside button select head menu input".split()) | RAW
#: Elements that go unless they hold most of the page's paragraph text, or an article or main: some sites wrap their whole page in one.
SHELLS = frozenset("form dialog fieldset label object".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead sidebar aside comment comments disqus replies respond reader cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skip".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that negate a junk name after them, as in no-comments and has-sidebar.
NEGATIONS = frozenset("no not non without has have with hide".split())
#: Elements whose text is running text.
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())


@dataclass(frozen=True)
class HtmlParams:
    """Points: base for a paragraph, one for each comma, one for each chars_point characters up to
    most_points; the parent gets all of them and each further ancestor half of the one below.
    Scores of article and main count `article` times. If the best container makes up at least
    article_share of the text of an article or main around it, that is taken in its place. A sibling
    of the best container is kept if its score reaches sibling_share of the best, or if its links
    are below sibling_links of its text and it is a paragraph of sibling_chars or shares the best
    one's tag and class. junk_share is what stays of the points of an element that has a junk name
    but is not pruned.
    """

    base: float = 1.0
    chars_point: int = 100
    most_points: int = 3
    article: float = 1.5
    article_share: float = 0.5
    sibling_share: float = 0.2
    sibling_chars: int = 80
    sibling_links: float = 0.25
    junk_share: float = 0.5


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None = None
    attributes: str = ""
    children: list = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0
    named_junk: bool = False
    head: bool = False


class _Tags:
    """The tags of a page in order, in time linear in its length.

    A tag ends at the first > outside quotes. Where there is none, the < is text; the places that
    such a search met are kept, so that no later search goes over them again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.low, self.high = 0, -1  # from low on, the next stop is at high
        self.name_low, self.name_high = 0, -1
        self.dead: set[int] = set()
        self.without: dict[str, int] = {}  # a quote that does not come again from here on

    def _stop(self, at: int) -> int:
        if not self.low <= at <= self.high:
            m = _STOP.search(self.page, at)
            self.low, self.high = at, m.start() if m else len(self.page)
        return self.high

    def _name_end(self, at: int) -> int:
        if not self.name_low <= at <= self.name_high:
            self.name_low, self.name_high = at, _NAME_END.search(self.page, at).start()
        return self.name_high

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` has its >, or -1."""
        met, page = [], self.page
        while True:
            stop = self._stop(at)
            if stop in self.dead or stop == len(page):
                break
            if page[stop] == ">":
                return stop
            met.append(stop)
            quote = page[stop]
            if stop >= self.without.get(quote, len(page)):
                break
            close = page.find(quote, stop + 1)
            if close < 0:
                self.without[quote] = stop
                break
            at = close + 1
        self.dead.update(met)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first tag or note from `at` on; a note has no name."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if (m := _NOTE.match(page, at)) is not None:
                return at, m.end(), "", "", ""
            if at > self.last:
                # only a note can begin behind the last >
                at = min((x for x in (page.find("<!", at), page.find("<?", at)) if x >= 0), default=len(page))
                continue
            if (m := _START.match(page, at)) is not None:
                name = self._name_end(m.start(2))
                end = self._end(name)
                if end >= 0:
                    return at, end + 1, m[1], page[m.start(2) : name], page[name:end]
            at += 1


class _Open:
    """The open elements, with the depths of each tag's, so that nothing is searched by walking up."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {}

    def push(self, n: Node) -> None:
        self.depths.setdefault(n.tag, []).append(len(self.path))
        self.path.append(n)

    def nearest(self, tags) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def cut(self, depth: int) -> None:
        """End the elements from this depth on."""
        for n in self.path[depth:]:
            self.depths[n.tag].pop()
        del self.path[depth:]

    def close(self, tags, stops) -> None:
        """End the nearest element of these tags, unless one of the stops is nearer."""
        depth = self.nearest(tags)
        if depth > self.nearest(stops):
            self.cut(depth)


def parse(page: str) -> Node:
    """A tolerant tree of elements and text; unclosed elements end with their parent."""
    root = Node("root")
    open_, tags, at = _Open(root), _Tags(page), 0
    while (found := tags.next(at)) is not None:
        start, end, slash, tag, attributes = found
        if start > at:
            open_.path[-1].children.append(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if depth := open_.nearest((tag,)):
                open_.cut(depth)
            continue
        if tag in BLOCK:
            open_.close(("p",), STOPS["p"])
        if tag in CLOSES:
            open_.close(CLOSES[tag], STOPS.get(tag, ()))
        new = Node(tag, open_.path[-1], attributes)
        new.parent.children.append(new)
        if tag in RAW and not attributes.endswith("/"):
            close = _END[tag].search(page, at)
            end = close.start() if close else len(page)
            after = page.find(">", end)
            at = len(page) if after < 0 else after + 1
        elif tag not in VOID and not attributes.endswith("/"):
            open_.push(new)
    if at < len(page):
        open_.path[-1].children.append(page[at:])
    return root


def _named_junk(value: str) -> bool:
    """Whether a class or id holds a junk name that no word before it negates."""
    for name in value.split():
        for w in _NAME.findall(name):
            if w.lower() in NEGATIONS:
                break
            if w.lower() in JUNK_NAMES:
                return True
    return False


def _junk(n: Node, in_article: bool) -> bool:
    """Whether n is never article text; sets n.named_junk by its class and id, which alone do not decide."""
    if n.tag in JUNK_TAGS:
        return True
    n.named_junk = n.tag in SHELLS
    if n.tag == "header":
        return not in_article
    if not n.attributes or n.tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(n.attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in JUNK_ROLES:
            return True
        if name in ("class", "id") and n.tag not in HEADINGS and _named_junk(value):
            n.named_junk = True
    return False


def _paragraph_chars(root: Node) -> tuple[dict[int, int], dict[int, bool], dict[int, bool]]:
    """By element: the characters of its paragraphs, without those of junk tags, and whether it contains article or main, or h1."""
    order, inside = [], {}
    stack = [(root, False)]
    while stack:
        n, text = stack.pop()
        text = text or n.tag in PARAGRAPHS
        inside[id(n)] = text
        order.append(n)
        stack += [(c, text) for c in n.children if not isinstance(c, str) and c.tag not in JUNK_TAGS]
    chars, holds, titled = {}, {}, {}
    for n in reversed(order):
        titled[id(n)] = any(not isinstance(c, str) and (c.tag == "h1" or titled.get(id(c), False)) for c in n.children)
        chars[id(n)] = sum((len(" ".join(c.split())) if inside[id(n)] else 0) if isinstance(c, str) else chars.get(id(c), 0) for c in n.children)
        holds[id(n)] = any(not isinstance(c, str) and (c.tag in ("article", "main") or holds.get(id(c), False)) for c in n.children)
    return chars, holds, titled


def prune(n: Node, in_article: bool = False) -> None:
    """Take out what is never article text; of an article's own header, or of what has a junk name but
    holds the article's h1, only headings stay.

    An element with a junk name or of SHELLS goes too, unless it holds most of the page's paragraph text, or an
    article or main and is not itself in one, or (by its name only) is a paragraph of an article or part of its line.
    """
    chars, holds, titled = _paragraph_chars(n)
    most = chars[id(n)]

    def stays(c: Node, above: Node, inside: bool, lines: bool) -> bool:
        if 2 * chars.get(id(c), 0) > most or holds.get(id(c), False) and not inside:
            c.named_junk = False
            return True
        if c.tag in SHELLS:
            return False
        if c.tag in ("p", "pre"):
            return inside
        return c.tag not in BLOCK and (above.tag in PARAGRAPHS or above.tag not in BLOCK and above.tag != "root" or lines)

    stack = [(n, in_article)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        kept, lines = [], any(isinstance(c, str) and c.strip() for c in n.children)
        for c in n.children:
            if isinstance(c, str):
                if not n.head:
                    kept.append(c)
                continue
            if _junk(c, inside):
                continue
            c.head = c.tag == "header" or n.head and c.tag not in HEADINGS
            if c.named_junk and not stays(c, n, inside, lines):
                if not (inside or n.head) or not titled[id(c)]:
                    continue
                c.head = True
            if not n.head or c.tag in HEADINGS or c.tag in ("div", "hgroup", "section"):
                kept.append(c)
                stack.append((c, inside))
        n.children = kept


def _walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def measure(root: Node, p: HtmlParams) -> list[Node]:
    """Text lengths, link lengths and scores of all elements, in page order."""
    order = _walk(root)
    commas: dict[int, int] = {}
    for n in reversed(order):
        count = 0
        for c in n.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                n.chars += len(t)
                count += t.count(",") + t.count("،") + t.count("，")
            else:
                n.chars += c.chars
                n.link_chars += c.link_chars
                count += commas[id(c)]
        commas[id(n)] = count
        if n.tag == "a":
            n.link_chars = n.chars
    for n in order:
        direct = any(isinstance(c, str) and c.strip() for c in n.children)
        if n.chars and (n.tag in ("p", "pre", "td", "blockquote", "li", "dd") or n.tag in ("div", "section", "article", "main", "body") and direct):
            points = (p.base + commas[id(n)] + min(p.most_points, n.chars // p.chars_point)) * (p.junk_share if n.named_junk else 1)
            up = n.parent if n.tag in ("p", "pre", "td", "blockquote", "li", "dd") else n
            while up is not None and points > 0.01:
                up.score += points
                up, points = up.parent, points / 2
    for n in order:
        n.score *= p.article if n.tag in ("article", "main") else 1
        n.score *= 1 - n.link_chars / n.chars if n.chars else 0
    return order


def best_container(order: list[Node], p: HtmlParams) -> Node | None:
    """The element of the highest score, or the article or main that it makes up most of."""
    best = max((n for n in order if n.chars and n.tag not in ("root", "html")), key=lambda n: n.score, default=None)
    n = best
    while n is not None and n.tag != "root":
        if n.tag in ("article", "main"):
            return n if best.chars - best.link_chars >= p.article_share * (n.chars - n.link_chars) else best
        n = n.parent
    return best


def _class(n: Node) -> str | None:
    return next((value.strip("\"'") for name, value in _ATTRIBUTE.findall(n.attributes or "") if name.lower() == "class"), None)


def _kept_sibling(c: Node, best: Node, p: HtmlParams) -> bool:
    if c.chars and c.score >= max(10, best.score * p.sibling_share):
        return True
    if not c.chars or c.link_chars >= p.sibling_links * c.chars:
        return False
    if c.tag == "h1":
        return True
    alike = c.tag == best.tag and c.tag not in ("article", "main") and c.score > 0 and _class(c) not in (None, "") and _class(c) == _class(best)
    return alike or c.tag == "p" and c.chars >= p.sibling_chars


def _blocks(n: Node, out: list[list[str]]) -> None:
    """Append the text of n to out, a list of pieces for each block, in page order."""
    stack: list = [n]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            block = x.tag in BLOCK
            stack += ([None] if block else []) + x.children[::-1] + ([None] if block else [])


def main_text(page: str | None, p: HtmlParams = HtmlParams()) -> str:
    """The article's blocks joined by a line break; empty if the page has none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    best = best_container(measure(root, p), p)
    if best is None:
        return ""
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "root"):
        at = next(i for i, c in enumerate(best.parent.children) if c is best)
        # a headline stands before the story
        kept = [c for i, c in enumerate(best.parent.children) if c is best or not isinstance(c, str) and (c.tag != "h1" or i < at) and _kept_sibling(c, best, p)]
    out: list[list[str]] = [[]]
    for n in kept:
        out.append([])
        _blocks(n, out)
    lines = (" ".join(entities.unescape("".join(pieces)).split()) for pieces in out)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; others are ignored).

    A null or empty html, and a page without text, give an empty text of 0 characters; repeated
    rows are extracted one by one.
    """

    def run(batches):
        for b in slices(batches, "html", 4 << 20):
            texts = [main_text(t, p) for t in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
