"""HTML main text: gradient-boosted trees over DOM nodes and hierarchical decoding.

A tolerant scanner turns a page into block-level nodes and text blocks. Each node gets
features of its subtree's density, its and its ancestors' attribute tokens, its depth and
its siblings. Boosted trees give each node's log-odds of being article content, and a
dynamic program over the tree picks the best labelling in which a dropped node has no kept
descendant: a node either keeps and lets each child choose, or drops its whole subtree.

The trees are fitted here, on ``TRAIN_PAGES`` pages that a seeded generator composes
(articles, menus, headers, footers, sidebars, notices, adverts, forms and comments, with and
without telling names); the bound is that parameter, and no page of a corpus is used.

Defined results: null or empty html, and pages without article text, give an empty text;
page structure may be broken at will (unclosed, crossed or unknown tags; only text-only
elements such as script or title run to the end of the page if unclosed); character
references are decoded; white space within a block becomes one space; blocks are joined by
one newline; repeated rows are treated one by one.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import gbt
from foliant.llm.common import arrow_map

TRAIN_PAGES = 700
NODE_WEIGHT = 1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "select", "head", "xmp", "noembed", "noframes"}
#: Of these, the ones with markup within: left open, they end at the next block tag (the others run to the end of the page).
MARKUP = {"noscript", "template", "svg", "math", "object", "canvas", "select"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {
    "html", "body", "div", "p", "section", "article", "main", "aside", "nav", "header", "footer", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption",
    "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "legend", "address", "details", "summary", "dialog", "center", "hgroup", "menu", "button", "label", "option", "search",
}
# ends are searched in the source itself: lower() would move offsets, as it lengthens some letters
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
_BODY = re.compile(r"<body(?=[\s/>])", re.I | re.A)
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({'|'.join(sorted(MARKUP))})(?=[\s/>])([^>]*+)>", re.I | re.A | re.S)
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'option'}))})(?=[\s/>])", re.I | re.A)
#: Starting one of these ends an open one of these (up to the named container).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"form"})}

#: Attribute tokens that tell of chrome and of content.
CHROME = (
    {"ad", "ads", "adv", "advert", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "adsense", "commercial"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "crumbs", "tabs", "pagination", "pager", "toc", "topbar", "toolbar", "skip"},
    {"sidebar", "aside", "side", "rail", "widget", "widgets", "related", "recommended", "popular", "trending", "more", "tags", "archive"},
    {"footer", "foot", "copyright", "legal", "colophon", "bottom", "credits", "imprint"},
    {"header", "masthead", "logo", "branding", "hero", "head", "banner", "top"},
    {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "thread", "commentlist", "reviews"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "signup", "paywall", "warning", "announcement", "notification", "privacy"},
    {"share", "sharing", "social", "follow", "login", "search", "form", "contact", "author", "byline", "meta", "date"},
)
CONTENT = {"article", "content", "main", "post", "entry", "body", "text", "story", "page", "prose", "richtext", "articlebody", "copy", "paragraph"}
ROLES = {"navigation": 1, "complementary": 2, "contentinfo": 3, "banner": 4, "dialog": 6, "alert": 6, "alertdialog": 6, "search": 7, "form": 7, "menu": 1, "menubar": 1}
TAGS = ("p", "div", "li", "h1", "h2", "article", "main", "section", "nav", "aside", "header", "footer", "form", "td", "table", "ul", "blockquote", "pre", "figure", "button")
_TAG_NO = {t: k for k, t in enumerate(TAGS)} | {"ol": TAGS.index("ul"), "dl": TAGS.index("ul"), "menu": TAGS.index("nav"), "tr": TAGS.index("td"), "th": TAGS.index("td"), "h3": TAGS.index("h2"), "h4": TAGS.index("h2"), "h5": TAGS.index("h2"), "h6": TAGS.index("h2"), "label": TAGS.index("button"), "fieldset": TAGS.index("form"), "option": TAGS.index("button"), "dialog": TAGS.index("aside"), "figcaption": TAGS.index("figure"), "dd": TAGS.index("li"), "dt": TAGS.index("li"), "search": TAGS.index("form")}
#: Tags that tell the same as an attribute token of that group.
TAG_TOKENS = {"nav": 1, "menu": 1, "aside": 2, "footer": 3, "header": 4, "dialog": 6, "form": 7, "search": 7, "article": len(CHROME), "main": len(CHROME)}
_TOKEN_NO = {w: k for k, ws in reversed(list(enumerate(CHROME))) for w in ws}


def markup_ends(source: str) -> dict[int, int]:
    """Where each closed element of MARKUP ends, by its start; elements left open have no entry."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _MARKUP.finditer(source):
        if m[2]:
            own = opened.setdefault(m[2].lower(), [])
            if m[1]:
                if own:
                    ends[own.pop()] = m.start()
            elif not m[3].endswith("/"):
                own.append(m.start())
    return ends


class Page:
    """The block-level nodes of a page (0 is the root) and its text blocks in order."""

    __slots__ = ("tag", "parent", "depth", "attrs", "blocks")

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth, self.attrs = ["html"], [-1], [0], [""]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters within links
        self._scan(source)

    def _scan(self, source: str) -> None:
        stack, opened = [0], {}
        texts: list[str] = []
        link, linked, at = 0, 0, 0
        closed = None

        def flush() -> None:
            nonlocal linked
            if texts:
                text = " ".join("".join(texts).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                texts.clear()
            linked = 0

        def pop(to: int) -> None:
            while len(stack) > to:
                opened[self.tag[stack.pop()]] -= 1

        def say(raw: str) -> None:
            nonlocal linked
            raw = html.unescape(raw) if "&" in raw else raw
            texts.append(raw)
            if link:
                linked += len(raw.strip())

        pos = 0
        while (m := _TOKEN.search(source, pos)) is not None:
            if m.start() > at:
                say(source[at : m.start()])
            pos = at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing = name.lower(), (m[1] or m[4])
            if name in RAW:
                if not closing and not (m[3] or m[6] or "").endswith("/"):
                    if name in MARKUP:
                        if closed is None:
                            closed = markup_ends(source)
                        end = closed.get(m.start())
                        if end is None:
                            end = x.start() if (x := _BLOCK.search(source, pos)) else len(source)
                    else:
                        end = x.start() if (x := _CLOSE[name].search(source, pos)) else len(source)
                        if name == "head":
                            end = x.start() if (x := _BODY.search(source, pos, end)) else end
                            if end == len(source):
                                continue  # an unclosed head: go on reading
                    pos = at = end
            elif name == "a":
                link = 0 if closing else 1
            elif name == "br":
                texts.append(" ")
            elif name == "hr":
                flush()
            elif name in BLOCK:
                flush()
                link = 0
                if closing:
                    if opened.get(name):
                        k = len(stack) - 1
                        while self.tag[stack[k]] != name or k == 0:
                            k -= 1
                        pop(k)
                    continue
                if name in ("html", "body"):
                    if name == "body" and not self.attrs[0]:
                        self.attrs[0] = m[3] or m[6] or ""
                    continue
                if opened.get("p") and name not in ("button", "label", "option"):
                    k = len(stack) - 1
                    while k and self.tag[stack[k]] != "p":
                        k -= 1
                    pop(k)
                ends, stop = ENDS.get(name, ((), ()))
                k = len(stack) - 1
                while ends and k and self.tag[stack[k]] not in stop:
                    if self.tag[stack[k]] in ends:
                        pop(k)
                    k -= 1
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.depth.append(len(stack))
                self.attrs.append(m[3] or m[6] or "")
                stack.append(len(self.tag) - 1)
                opened[name] = opened.get(name, 0) + 1
        if at < len(source):
            say(source[at:])
        flush()


WIDTH = 20 + len(TAGS) + 2 * (len(CHROME) + 1)


@lru_cache(maxsize=20_000)
def attr_tokens(attrs: str) -> tuple[int, ...]:
    """Which token groups (the last: content) the class, id and role of a tag have."""
    found = set()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "itemprop", "aria-label", "name", "data-role"):
            for w in _WORD.findall(value):
                w = w.lower()
                if w in _TOKEN_NO:
                    found.add(_TOKEN_NO[w])
                elif w in CONTENT:
                    found.add(len(CHROME))
        elif name == "role":
            if value.lower() in ROLES:
                found.add(ROLES[value.lower()])
            elif value.lower() in ("main", "article"):
                found.add(len(CHROME))
    return tuple(sorted(found))


def features(page: Page) -> np.ndarray:
    """A row of features for each node."""
    n = len(page.tag)
    groups = len(CHROME) + 1
    chars, links, marks, count, longest = (np.zeros(n) for _ in range(5))
    own_chars = np.zeros(n)
    for node, text, linked in page.blocks:
        size = len(text)
        own_chars[node] += size
        chars[node] += size
        links[node] += linked
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        count[node] += 1
        longest[node] = max(longest[node], size)
    parent, nodes, paragraphs = page.parent, np.ones(n), np.zeros(n)
    x = np.zeros((n, WIDTH))
    children, place, last = np.zeros(n), np.zeros(n), {}
    before = np.zeros(n)
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        marks[p] += marks[k]
        count[p] += count[k]
        nodes[p] += nodes[k]
        paragraphs[p] += paragraphs[k] + (page.tag[k] == "p" and own_chars[k] > 0)
        if longest[k] > longest[p]:
            longest[p] = longest[k]
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        p = parent[k]
        place[k] = children[p]
        children[p] += 1
        same[p, page.tag[k]] = same.get((p, page.tag[k]), 0) + 1
        if p in last:
            before[k] = chars[last[p]]
        last[p] = k
    up = np.array(parent)
    up[0] = 0
    total = max(chars[0], 1)
    x[:, 0] = np.log1p(chars)
    x[:, 1] = links / np.maximum(chars, 1)
    x[:, 2] = chars / nodes  # subtree density
    x[:, 3] = marks / np.maximum(chars, 1)
    x[:, 4] = page.depth
    x[:, 5] = place
    x[:, 6] = children[up]
    x[:, 7] = place / np.maximum(children[up], 1)
    x[:, 8] = chars / total
    x[:, 9] = np.log1p(longest)
    x[:, 10] = np.log1p(count)
    x[:, 11] = np.log1p(paragraphs)
    x[:, 12] = children
    x[:, 13] = np.log1p(before)
    x[:, 14] = chars / np.maximum(chars[up], 1)
    x[:, 15] = links[up] / np.maximum(chars[up], 1)
    x[:, 16] = np.log1p(chars[up])
    x[:, 17] = np.log1p(own_chars)
    x[:, 18] = chars / np.maximum(count, 1)
    at = 20
    for k, tag in enumerate(page.tag):
        no = _TAG_NO.get(tag)
        if no is not None:
            x[k, at + no] = 1
    at += len(TAGS)
    for k in range(n):
        for g in attr_tokens(page.attrs[k]) if page.attrs[k] else ():
            x[k, at + g] = 1
        if (g := TAG_TOKENS.get(page.tag[k])) is not None:
            x[k, at + g] = 1
        if k:  # what the chain of ancestors says, nearest first
            p = parent[k]
            x[k, at + groups : at + 2 * groups] = np.maximum(x[p, at : at + groups], 0.8 * x[p, at + groups : at + 2 * groups])
            x[k, 19] = same[p, page.tag[k]] / children[p]
    return x


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """The best labelling of the nodes in which every kept node's ancestors are kept.

    A node's vote is weighted by the text that is directly in it, so that a container is
    decided by what it holds.
    """
    n = len(page.tag)
    weight = np.full(n, NODE_WEIGHT)
    for node, text, _ in page.blocks:
        weight[node] += np.log1p(len(text))
    vote = np.clip(logits, -6, 6) * weight
    keep, drop = vote.copy(), -vote
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    out = [bool(keep[0] > drop[0]) or n > 1]
    for k in range(1, n):
        out.append(out[page.parent[k]] and bool(keep[k] > drop[k]))
    return out


def main_text(page: Page, logits: np.ndarray) -> str:
    kept = decode(page, logits)
    return "\n".join(text for node, text, _ in page.blocks if kept[node])


class Composer:
    """Training pages with the truth beside them: html is made of (markup, is_content) parts."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(("th", "en", "er", "on", "an", "re", "st", "es", "ou", "in", "la", "de", "ing", "ion", "ble", "ä", "é")) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [self.word() + (r.choice(",.;") if r.random() < 0.12 else "") for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + r.choice(("", ".", ".", "."))

    def attr(self, *names: str, chance: float = 0.75) -> str:
        r = self.r
        if not names or r.random() > chance:
            return r.choice(("", "", ' class="c1"', ' class="box wide"', ' id="x7"'))
        name = r.choice(names)
        return f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", "-1", " col", "-box", "_wrap"))}"'

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(r.randint(low, high))]
        style = r.randint(0, 2)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style == 0 else " | ".join(items) if style == 1 else "".join(f"<div>{x}</div>" for x in items)

    def wrap(self, tags: tuple[str, ...], names: tuple[str, ...], body: str, chance: float = 0.8) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attr(*names, chance=1 if tag == 'div' or tag == 'section' else chance)}>{body}</{tag}>"

    def chrome(self) -> str:
        """A piece of boilerplate."""
        r = self.r
        para = lambda a, b: r.choice(("{}", "<p>{}</p>", "<p>{}</p>", "<span>{}</span>", "<div>{}</div>")).format(self.words(a, b))
        kind = r.randint(0, 9)
        if kind == 0:
            return self.wrap(("nav", "div", "nav"), ("menu", "nav", "navbar", "breadcrumbs", "pagination", "main-menu"), self.links(3, 12))
        if kind == 1:
            return self.wrap(("header", "div"), ("header", "masthead", "site-header", "topbar", "page-header"), r.choice(("", f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(2, 5)}</h2>")) + r.choice(("", para(3, 14))) + r.choice(("", self.links(2, 6))))
        if kind == 2:
            return self.wrap(("footer", "div", "footer"), ("footer", "copyright", "site-footer", "legal", "imprint"), para(3, 30) + r.choice(("", self.links(2, 8))))
        if kind == 3:
            return self.wrap(("aside", "div", "aside"), ("sidebar", "widget", "related", "rail", "popular", "more-stories"), f"<h3>{self.words(1, 4)}</h3>" * r.randint(0, 1) + "".join(para(4, 40) for _ in range(r.randint(1, 3))) + r.choice(("", self.links(2, 9))))
        if kind in (4, 5):
            return self.wrap(("div", "div", "section", "aside"), ("ad", "ads", "advert", "banner", "promo", "sponsored", "ad-slot", "advertisement"), para(3, 40) + r.choice(("", "", f'<a href="/x">{self.words(1, 4)}</a>')))
        if kind == 6:
            return self.wrap(("div", "div", "section", "dialog"), ("cookie-notice", "consent", "alert", "notice", "popup", "newsletter", "modal", "announcement", "subscribe", "cookie-banner", "notification"), para(5, 40) + r.choice(("", "<button>" + self.words(1, 2) + "</button>")))
        if kind == 7:
            return f"<form{self.attr('search', 'login', 'signup', 'contact')}>" + r.choice(("", para(2, 20))) + f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 2)}</button></form>"
        if kind == 8:
            comments = "".join(self.wrap(("div", "li", "article", "p"), ("comment", "reply", "comment-body"), para(3, 45), 0.6) for _ in range(r.randint(1, 6)))
            return self.wrap(("section", "div", "ol"), ("comments", "comment-list", "replies", "discussion", "respond"), f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + comments)
        return self.wrap(("div", "ul"), ("share", "social", "byline", "meta", "tags", "author", "follow-us"), self.links(2, 6))

    def block(self) -> str:
        """A piece of an article."""
        r = self.r
        kind = r.random()
        if kind < 0.72:
            text = self.words(*r.choice(((1, 8), (8, 40), (20, 90), (60, 200))))
            if r.random() < 0.15:
                text = f'{text} <a href="/l">{self.words(1, 3)}</a> {self.words(1, 9)}'
            if r.random() < 0.2:
                text = f"<b>{text}<br>"
            return f"<p{self.attr('text', 'paragraph', chance=0.1)}>{text}" + r.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.8:
            return f"<h{(k := r.randint(2, 4))}>{self.words(1, 8)}</h{k}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{r.choice(('{}', '<p>{}</p>')).format(self.words(5, 40))}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src='x'><figcaption>{self.words(3, 15)}</figcaption></figure>"
        return r.choice(("<pre>{}</pre>", "<div>{}</div>", "<section><p>{}</p></section>")).format(self.words(5, 60))

    def page(self) -> tuple[str, list[bool]]:
        """Html and, for every text block that the scanner finds, whether it is content."""
        r = self.r
        parts: list[tuple[str, bool]] = [("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>", False)]
        parts += [(self.chrome(), False) for _ in range(r.randint(0, 4))]
        tag, names = r.choice((("article", ()), ("article", ("post", "entry")), ("main", ("content",)), ("div", ("content", "article-body", "post", "entry-content", "story", "main-text")), ("div", ()), ("section", ("content", "article"))))
        deep = r.randint(0, 2)
        parts.append(("<div>" * deep + f"<{tag}{self.attr(*names, chance=0.9)}>", False))
        if r.random() < 0.8:
            parts.append((f"<h1>{self.words(2, 12)}</h1>", True))
        brief = r.random() < 0.3
        for _ in range(r.choice((1, 1, 2)) if brief else r.choice((1, 2, 3, 5, 8, 14, 25))):
            if r.random() < 0.06:
                parts.append((self.chrome(), False))
            parts.append((f"<p>{r.choice(('', '', '<b>'))}{self.words(1, 9)}{r.choice(('', '<br>'))}" + r.choice(("</p>", "")) if brief else self.block(), True))
        if r.random() < 0.25:
            parts.append((self.chrome(), False))
        parts.append((f"</{tag}>" + "</div>" * deep, False))
        parts += [(self.chrome(), False) for _ in range(r.randint(0, 4))]
        if r.random() < 0.9:
            parts.append(("</body></html>", False))
        flags: list[bool] = []
        for body, content in parts:
            flags += [content] * len(Page(f"<body>{body}").blocks)
        return "".join(x[0] for x in parts), flags


def training_rows(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of the nodes of composed pages; a node's target is most of its text's."""
    composer = Composer(seed)
    xs, ys = [], []
    while len(xs) < pages:
        source, flags = composer.page()
        page = Page(source)
        if len(page.blocks) != len(flags):
            continue  # markup of neighbouring parts ran together
        good, total = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for (node, text, _), flag in zip(page.blocks, flags, strict=True):
            while node >= 0:
                good[node] += flag * len(text)
                total[node] += len(text)
                node = page.parent[node]
        used = total > 0
        xs.append(features(page)[used])
        ys.append((2 * good > total)[used])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> gbt.Model:
    """The model; the same for the same parameters."""
    return gbt.fit(*training_rows(pages, seed))


def extract(sources: list[str], model: gbt.Model) -> list[str]:
    """Main texts of pages; all nodes of a batch go through the trees together."""
    pages = [Page(x) for x in sources]
    rows = [features(p) for p in pages]
    logits = model.logits(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, x in zip(pages, rows, strict=True):
        out.append(main_text(page, logits[at : at + len(x)]))
        at += len(x)
    return out


def extracted(pages: DataFrame, model: gbt.Model | None = None, per_call: int = 500) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or trained()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sources = batch.column(2).to_pylist()
        texts = [t for i in range(0, len(sources), per_call) for t in extract(sources[i : i + per_call], model)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return arrow_map(rows, each, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
