"""Main text of HTML pages by tree scoring.

Paragraphs pass points for their length and commas to their parent, half of them to the next ancestor and a third
to the one above, discounted by the share of text inside links. The container with most points is the article;
siblings that score well or hold running text are kept with it. Parts that are no article text by their element,
role or name (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) are cut out first. An
article or main element is cut for its name only where that says comment or advert, a part with a word of
``CONTENT`` not for names of a state, and none but comments and adverts if it holds most of the page's text. Inside an
article or main element a part is cut for its name only if the whole name says so (``share``, ``related-links``, but
not ``market share`` or ``related-work``), lists of links stay, and of its own header the headings do. A headline just
before the container belongs to it.

Defined cases: a null or empty page, and one without text, gives an empty text; unclosed and stray tags are read
as browsers do, roughly; an unclosed comment or script runs to the end; repeated rows are extracted one by one;
columns beyond the named ones are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "object", "select", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of the key closes an open element of the value, unless one of SCOPE lies between.
CLOSES = dict.fromkeys(BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}, {"p"}) | {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "p"}, "tfoot": {"tbody", "thead", "tr", "td", "th", "p"},
}
SCOPE = BLOCK - {"p", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", *HEADING}

#: Elements and roles that are never article text.
NO_TEXT = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset", "input", "label", "audio", "video", "head", *RAW}
NO_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Words in class and id that mark such a part: always, or only where no word of CONTENT stands beside it.
NO_NAME = re.compile(
    r"^(ads?|advert\w*|adsense|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|footer|breadcrumbs?|pagination|pager|cookies?|consent|gdpr|popup|modal"
    r"|newsletter|subscribe|subscription|paywall|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|related|recommended"
    r"|outbrain|taboola|skip|masthead|copyright|disclaimer|hidden)$"
)
WEAK_NAME = re.compile(r"^(sidebar|side|aside|header|banner|widgets?|notices?|alerts?|toolbar|rail|top|bottom|form|search|teasers?|extra|legal|message)$")
CONTENT = re.compile(r"^(content|article|main|body|story|text|entry|post|page|wrapper|container|layout)$")
#: Comments and adverts: their name counts for articles and for the longest part of a page too.
COMMENT_NAME = re.compile(r"^(ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|outbrain|taboola)$")
#: First and last words of names that tell a state or a category and no part, as in has-related or comments-open.
STATE_FIRST = {"has", "with", "without", "no", "is", "not", "show", "hide", "js", "category", "cat", "tag", "type", "format", "status"}
STATE_LAST = {"open", "opened", "closed", "on", "off", "enabled", "disabled", "active", "visible", "free"}
ROOTS = {"html", "body"}
#: Words that go with those of NO_NAME in the name of a part and say no more.
COMPANIONS = set("bar box block list links link items item section area widget wrapper container panel buttons button icons unit slot inner outer posts stories articles module row".split())


class _Tree:
    """Elements of a page by number, in page order, and its text in pieces."""

    def __init__(self, page: str):
        self.tag, self.parent, self.cut, self.name = ["html"], [-1], [False], [("", 0)]
        self.main, self.within = [False], [False]  # an article or main element; an element inside one
        self.mute, self.title = [False], [False]  # text of an article's header that is no heading; part of a heading
        self.whole: set[int] = set()  # elements whose whole name says that they are no article text
        self.soft: set[int] = set()  # elements that are cut for their name, unless they hold most of the page
        self.pieces: list[tuple[int, str | None]] = []  # (element, text), or None where a block begins or ends
        self.stack = [0]
        at = 0
        while True:
            found = _TAG.search(page, at)
            if found is None:
                self._text(page[at:])
                return
            self._text(page[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                self._close(tag)
                continue
            self._open(tag, found[3] or "")
            if tag in RAW and not (found[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                self._close(tag)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], html.unescape(text)))

    def _open(self, tag: str, attributes: str) -> None:
        closes = CLOSES.get(tag)
        if closes:
            for i in range(len(self.stack) - 1, 0, -1):
                open_ = self.tag[self.stack[i]]
                if open_ in closes:
                    self._pop(i)
                    break
                if open_ in SCOPE:
                    break
        if tag in ("html", "body"):
            number = self._add(tag, attributes)
            self.stack.append(number)
            return
        if tag == "br":
            self.pieces.append((self.stack[-1], " "))
            return
        if tag in BLOCK:
            self.pieces.append((self.stack[-1], None))
        number = self._add(tag, attributes)
        if tag not in VOID:
            self.stack.append(number)

    def _close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            open_ = self.tag[self.stack[i]]
            if open_ == tag:
                self._pop(i)
                return
            if tag not in BLOCK and open_ in BLOCK:
                return

    def _pop(self, i: int) -> None:
        if any(self.tag[k] in BLOCK for k in self.stack[i:]):
            self.pieces.append((self.stack[-1], None))
        del self.stack[i:]

    def _add(self, tag: str, attributes: str) -> int:
        parent = self.stack[-1]
        values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        role = values.get("role", "").lower()
        names = [[w.lower() for w in _NAME.findall(x)] for x in f"{values.get('class', '')} {values.get('id', '')}".split()]
        words = [w for x in names for w in x]
        content = any(map(CONTENT.match, words))
        strong, weak = any(map(NO_NAME.match, words)), any(map(WEAK_NAME.match, words))
        said = [w for x in names if x and x[0] not in STATE_FIRST and x[-1] not in STATE_LAST for w in x] if strong else []
        comment, part = any(map(COMMENT_NAME.match, said)), any(map(NO_NAME.match, said))
        main = tag in ("article", "main") or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").lower().replace(" ", "")
        free = main or content and not part
        named = tag not in ROOTS and (comment or not free and (strong or weak and not content))
        within = self.within[parent] or self.main[parent]
        own_header = tag == "header" and within and role in ("", "presentation", "none")
        self.tag.append(tag)
        self.parent.append(parent)
        self.within.append(within)
        self.title.append(self.title[parent] or tag in HEADING)
        self.mute.append((self.mute[parent] or own_header) and not self.title[-1])
        if named and not comment:
            self.soft.add(len(self.tag) - 1)
        if strong and all(NO_NAME.match(w) or w in COMPANIONS or w.isdigit() for w in words):
            self.whole.add(len(self.tag) - 1)
        self.cut.append(self.cut[parent] or tag in NO_TEXT and not own_header or role in NO_ROLE or named and comment or hidden and tag not in ("html", "body"))
        self.name.append((values.get("class", ""), (content or tag in ("article", "main")) - weak))
        self.main.append(main)
        return len(self.tag) - 1


def _cut_by_name(tree: _Tree) -> None:
    """Cut the parts named as no article text, but for those that hold most of the page's text outside links.

    A part is not kept for its length where an article or main element stands outside all such parts. Inside an
    article or main element only whole names count.
    """
    tree.soft = {k for k in tree.soft if not tree.within[k] or k in tree.whole}
    if not tree.soft:
        return
    n = len(tree.tag)
    linked, named, size = [False] * n, [False] * n, [0] * n
    for k in range(1, n):
        parent = tree.parent[k]
        linked[k] = tree.tag[k] == "a" or linked[parent]
        named[k] = k in tree.soft or named[parent]
    for k, text in tree.pieces:
        if text and not tree.cut[k] and not tree.mute[k] and not linked[k]:
            size[k] += len(_SPACE.sub(" ", text).strip())
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
    article = any(tree.main[k] and not named[k] and not tree.cut[k] and size[k] for k in range(n))
    for k in range(1, n):
        tree.cut[k] |= tree.cut[tree.parent[k]] or k in tree.soft and (article or 2 * size[k] <= size[0])


def _headline(tree: _Tree, top: int, total: Sequence[int]) -> set[int]:
    """The heading just before the container, if the container has none of the first level."""
    if any(tree.tag[k] == "h1" and not tree.cut[k] and total[k] for k in range(top + 1, _end(tree, top))):
        return set()
    before = [k for k in range(1, top) if tree.parent[k] == tree.parent[top] and not tree.cut[k] and total[k]]
    return {before[-1]} if before and tree.tag[before[-1]] in ("h1", "h2") else set()


def _end(tree: _Tree, k: int) -> int:
    """The number after the last element inside element k."""
    n, inside = k + 1, {k}
    while n < len(tree.tag) and tree.parent[n] in inside:
        inside.add(n)
        n += 1
    return n


def main_text(page: str | None) -> str:
    """Blocks of the article, two line ends between them."""
    if not page:
        return ""
    tree = _Tree(page)
    _cut_by_name(tree)
    n = len(tree.tag)
    block, linked = [0] * n, [False] * n
    for k in range(1, n):
        parent = tree.parent[k]
        block[k] = k if tree.tag[k] in BLOCK else block[parent]
        linked[k] = tree.tag[k] == "a" or linked[parent]
    own, own_links, commas, total, links, n_links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for k, text in tree.pieces:
        if text and not tree.cut[k] and not tree.mute[k]:
            size, b = len(_SPACE.sub(" ", text).strip()), block[k]
            own[b] += size
            commas[b] += text.count(",") + text.count("，") + text.count("、")
            if linked[k]:
                own_links[b] += size
    for k in range(n):
        total[k], links[k] = own[k], own_links[k]
    for k in range(n - 1, 0, -1):
        if not tree.cut[k]:
            parent = tree.parent[k]
            total[parent] += total[k]
            links[parent] += links[k]
            n_links[parent] += n_links[k] + (tree.tag[k] == "a")
    density = [links[k] / total[k] if total[k] else 0.0 for k in range(n)]

    points = [0.0] * n
    for k in range(n):
        if own[k] and not tree.cut[k] and tree.tag[k] not in HEADING:
            given = ((own[k] >= 25) + commas[k] + min(own[k] / 100, 3.0)) * (1 - own_links[k] / own[k])
            if tree.tag[k] not in ("p", "li", "pre", "td", "dd", "blockquote"):
                points[k] += given
            ancestor = tree.parent[k]
            for share in (1.0, 0.5, 1 / 3):
                if ancestor < 0:
                    break
                points[ancestor] += given * share
                ancestor = tree.parent[ancestor]
    score = [points[k] * (1 - density[k]) * (1 + 0.25 * tree.name[k][1]) for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if not score[best]:
        best = next((k for k in range(n) if tree.main[k] and total[k]), 0)
    top, k = best, best
    while k > 0:
        if tree.main[k] and not tree.cut[k]:
            top = k
            break
        k = tree.parent[k]
    kept = {top}
    for k in range(1, n):
        if tree.parent[k] == tree.parent[top] and k != top and not tree.cut[k] and total[k]:
            bonus = 0.2 * score[best] if tree.name[k][0] and tree.name[k][0] == tree.name[top][0] else 0.0
            # Beside an element that calls itself the article, only others of the kind and long paragraphs belong to it.
            running = tree.tag[k] == "p" and (total[k] >= 80 and density[k] < 0.25 or density[k] == 0 and total[k] >= 25 and not tree.main[top])
            alike = tree.tag[k] == tree.tag[top] if tree.main[top] else True
            # A short part of the same element and class goes on with the text, as a closing section does.
            twin = tree.tag[k] == tree.tag[top] != "p" and tree.name[k][0] == tree.name[top][0] and density[k] < 0.25 and total[k] >= 25 and k > top
            if alike and score[k] + bonus >= max(5.0, 0.2 * score[best]) or running or twin:
                kept.add(k)
    kept |= _headline(tree, top, total)

    inside = [False] * n
    for k in range(n):
        menu = tree.tag[k] in ("ul", "ol", "dl", "table", "div", "section") and n_links[k] >= 2 and density[k] > 0.6 and k not in kept and not tree.within[k]
        tree.cut[k] |= menu or k > 0 and tree.cut[tree.parent[k]]
        inside[k] = not tree.cut[k] and (k in kept or k > 0 and inside[tree.parent[k]])
    blocks, now = [], []
    for k, text in [*tree.pieces, (0, None)]:
        if text is None:
            if joined := _SPACE.sub(" ", "".join(now)).strip():
                blocks.append(joined)
            now = []
        elif inside[k] and not tree.mute[k]:
            now.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """``keep`` columns and the text of every page."""
    return add_columns(pages, page, keep, [("text", T.StringType())], lambda: lambda column: ([main_text(x) for x in column.to_pylist()],))


def report(pages: DataFrame) -> DataFrame:
    """Contract columns of every page."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
