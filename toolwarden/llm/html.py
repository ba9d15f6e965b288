"""Main text of web pages by tree scoring.

A page is read as a tree of elements with the usual repairs of unclosed tags.
Elements that are never article text (scripts, navigation, forms ...), or whose
class, id or role names such a part, are left out.  Every paragraph passes
points for its length and its commas to its ancestors, halved for the
grandparent and less for those above; an element's points are discounted by the
share of its text inside links.  The article is the element with the most points
with what stands beside it, whatever its size, up to the enclosing article, main or
element named like one, without parts that are mostly links.  Further up, beside
parts that are left out, only sections, paragraphs and the like and what has points
belong to it.

Blocks (paragraphs, headings, list items, table cells ...) follow each other in
page order, separated by an empty line; inside a block white space is one space.

Defined results: a NULL or empty page, or one without text, gives an empty
text; without a paragraph that scores, the whole body is taken; repeated rows
are read one by one; an empty table gives no rows; a column named as a result is
replaced.  A page is a row in its task: no shuffle, no hot key.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, carried, with_results

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math object".split())
#: The end tag of a raw element; one that is cut off reaches to the end of the page.
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
NEVER = RAW | frozenset("head nav footer aside form button select option label fieldset dialog menu canvas audio video map figcaption".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article".split())
#: A start tag closes an open element of these names (up to the nearest one of the scope).
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tbody thead tr td th", ("table",)),
    "option": ("option", ("select",)),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in CLOSES.items()}

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Words of a class, id or role that mark parts that are not the article.
UNLIKELY = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs combx comment comments commentlist community consent "
    "cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay "
    "pager pagination paywall popup promo promoted promotion recommended related remark replies reply respond rss share sharing shoutbox "
    "sidebar skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets search login signup "
    "alert toc copyright contentinfo complementary dialog alertdialog".split()
)
#: Of these, the ones that count even where another word speaks for the article ("post-comments").
CERTAIN = frozenset(
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "menu nav navbar newsletter promo related replies reply respond share sharing sponsored".split()
)
#: Words that mark the article; with one of them only a certain word leaves an element out.
LIKELY = frozenset("article articlebody body content contents entry hentry main maincontent page post story text prose".split())
BONUS = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0}
#: Elements that go with an article even where parts beside them do not.
TEXTS = frozenset("section p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure details".split())
#: Elements without text of their own, which tell nothing about their neighbours.
UNSEEN = VOID | frozenset("head script style noscript template".split())
MOST_LINKS = 0.25
MIN_PARAGRAPH = 25
MAX_POINTS_FOR_LENGTH = 3


class Element:
    __slots__ = ("name", "parent", "children", "points", "size", "linked", "out", "likely")

    def __init__(self, name: str, parent: Element | None, out: bool = False, likely: bool = False):
        self.name, self.parent, self.out, self.likely = name, parent, out, likely
        self.children: list = []
        self.points, self.size, self.linked = 0.0, 0, 0


def _marks(attributes: str) -> tuple[bool, bool]:
    """Is the element to be left out, or likely the article, by its attributes?"""
    out = likely = False
    found: set[str] = set()
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            out = True
        elif key == "style":
            out = out or "display:none" in value.replace(" ", "").lower()
        else:
            words = {w.lower() for w in _WORDS.findall(value)}
            likely = likely or bool(words & LIKELY)
            found |= words & UNLIKELY
    out = out or bool(found & CERTAIN) or bool(found) and not likely
    return out, likely


def tree(html: str, by_names: bool = True) -> Element:
    """The elements and texts of a page; texts are strings among the children.  ``by_names``
    leaves elements out by their class, id or role, too."""
    root = Element("#root", None)
    at, done = root, 0
    while m := _MARKUP.search(html, done):
        if m.start() > done:
            at.children.append(html[done : m.start()])
        done = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            open_ = at
            while open_ is not None and open_.name != name:
                if open_.name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "body", "html"):
                    open_ = None  # an end tag does not reach out of a cell
                    break
                open_ = open_.parent
            if open_ is not None and open_.parent is not None:
                at = open_.parent
            elif name in ("p", "br"):
                at.children.append(Element(name, at))
            continue
        if name in BLOCKS and name not in ("html", "body"):  # a block ends an open paragraph
            up = at
            while up is not None and up.name not in BLOCKS:
                up = up.parent
            if up is not None and up.name == "p":
                at = up.parent
        if name in CLOSES:
            closed, scope = CLOSES[name]
            up, found = at, None
            while up is not None and up.name not in scope:
                if up.name in closed:
                    found = up
                up = up.parent
            if found is not None:
                at = found.parent
        attributes = m[3]
        out, likely = _marks(attributes) if attributes else (False, False)
        out = (out and by_names) or name in NEVER
        out = out and name not in ("html", "body", "article", "main")
        if name == "header" and not any(x.name in ("article", "main") for x in _above(at)):
            out = True
        element = Element(name, at, out, likely)
        at.children.append(element)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            # What is inside is no markup: the page goes on behind the end tag.
            end = _ENDS[name].search(html, done)
            done = end.end() if end else len(html)
            continue
        at = element
    if done < len(html):
        at.children.append(html[done:])
    return root


def _above(x: Element | None):
    while x is not None:
        yield x
        x = x.parent


def _measure(root: Element) -> list[Element]:
    """Sizes of all elements; those left in, in page order, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Element) and not c.out)
    for x in reversed(order):
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        inner = [c for c in x.children if isinstance(c, Element) and not c.out]
        x.size = own + sum(c.size for c in inner)
        x.linked = x.size if x.name == "a" else sum(c.linked for c in inner)
    return order


def _links(x: Element) -> float:
    return x.linked / x.size if x.size else 0.0


def _own_text(x: Element) -> str:
    """The text of a paragraph: its own and that of elements inside it that are not blocks."""
    parts, stack = [], list(reversed(x.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.out and c.name not in BLOCKS:
            stack.extend(reversed(c.children))
    return "".join(parts)


def _score(order: list[Element]) -> list[Element]:
    found: dict[int, Element] = {}
    for x in order:
        if x.name not in PARAGRAPHS:
            continue
        text = _own_text(x).strip()
        if len(text) < MIN_PARAGRAPH:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, MAX_POINTS_FOR_LENGTH)) * (1 - _links(x))
        for level, above in enumerate(_above(x.parent)):
            if above.parent is None or level > 4:
                break
            if id(above) not in found:
                found[id(above)] = above
                above.points += BONUS.get(above.name, 0.0) + (10.0 if above.likely else 0.0)
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
        if x.name not in ("p", "li", "dd"):  # a block that holds its text itself
            if id(x) not in found:
                found[id(x)] = x
                x.points += BONUS.get(x.name, 0.0)
            x.points += points
    return list(found.values())


def _blocks(nodes: list) -> list[str]:
    """The texts between block boundaries, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        c = stack.pop()
        if c is None:
            close()
        elif isinstance(c, str):
            parts.append(c)
        elif c.out:
            continue
        elif c.name == "br":
            parts.append(" ")
        elif c.name in BLOCKS:
            close()
            stack.append(None)
            stack.extend(reversed(c.children))
        else:
            stack.extend(reversed(c.children))
    close()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by an empty line."""
    if not html:
        return ""
    return _article(tree(html)) or _article(tree(html, by_names=False))


def _article(root: Element) -> str:
    order = _measure(root)
    scored = _score(order)
    if not scored:
        return "\n\n".join(_blocks(root.children))
    best = max(scored, key=lambda x: x.points * (1 - _links(x)))
    return "\n\n".join(_blocks(_whole(best)))


def _content(x: Element | str) -> bool:
    """Neither left out nor mostly links."""
    return isinstance(x, str) or not x.out and _links(x) < MOST_LINKS


def _whole(best: Element) -> list:
    """The nodes of the article around the element with the most points, in page order.

    One long section may outweigh its parent, so the article is looked for above: an enclosing
    article is taken whole, and up to an enclosing main, or an element that is named like an
    article, siblings stay whatever their size, as do those of ``best`` itself.  Further up, and
    in the body, they do if nothing beside them is to be left out; else they need points, or to be
    sections, paragraphs or the like."""
    line = [x for x in _above(best) if x.name not in ("body", "html", "#root")]
    named = [[x for x in line if x.name == n] for n in ("main", "article")]
    likely = [x for x in line if x.likely]
    holder = next((found[-1] for found in (*named, likely) if found), None)
    articles = named[1]
    x = articles[-1] if articles else best
    taken: list = [x]
    inside = holder is not None
    while x.parent is not None and x.name not in ("body", "html", "#root"):
        if x is holder:
            if x.name in ("main", "article"):
                break
            inside = False
        low = x.parent.name in ("body", "html", "#root")
        every = not low and (inside or x is best and x is not holder) or not any(map(_rejected, x.parent.children))
        taken = [c for s in x.parent.children for c in (taken if s is x else [s] if _goes(s, best, every) else [])]
        x = x.parent
    return taken


def _rejected(x: Element | str) -> bool:
    return not _content(x) and x.name not in UNSEEN


def _goes(x: Element | str, best: Element, every: bool) -> bool:
    """Does a neighbour belong to the article?"""
    if every or not _content(x) or isinstance(x, str):
        return every and _content(x)
    need = max(10.0, best.points * (1 - _links(best)) * 0.2)
    return x.name in TEXTS or x.points * (1 - _links(x)) >= need


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the article) and ``n_chars`` (its code points)."""
    names = pages.columns

    def compute(batch: pa.RecordBatch) -> list:
        texts = [main_text(h) for h in batch.column("page").to_pylist()]
        return [texts, [len(t) for t in texts]]

    held = pages.select(*carried(names), F.col(f"`{html}`").alias("page"))
    fields = T.StructType().add("found", T.StringType()).add("chars", T.LongType())
    done = appended(held, fields, compute)
    return done.select(*with_results(names, {"text": F.col("found"), "n_chars": F.col("chars")}))
