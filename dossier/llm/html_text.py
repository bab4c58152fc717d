"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the hierarchy.

A page is parsed into its block elements (inline markup belongs to the block's text; script, style, head and
the like are skipped; form controls have no text). A skipped element ends at its own end tag or where an element
around it ends; one without an end tag of its own ends at the next block. Each element has features of its tag, the tokens of its
class, id and role, its depth and siblings, the density of its subtree in text, tags, links and punctuation,
and what its ancestors are. Boosted trees give the log-odds that it belongs to, or holds, the main text.
Decoding chooses for all elements at once: a dropped element's descendants are dropped, and of all such
choices the one of greatest total log-odds, weighted by text, is taken.

The trees are fitted here, on pages that are made up with known labels (`made_up_page`): no page of the input
is needed, so the model is the same for every input.

Text: character references decoded, white space within a block one space, blocks in page order joined by two
line feeds. A null, empty or text-less page has the empty text. Rows that repeat are read each. Other columns
are not looked at; an empty table gives no rows. Very long pages are read whole, in time linear in their length but for
their depth. Of two choices with equal total the element is dropped.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript svg iframe object canvas math audio video head title select textarea button option datalist".split())
RAW = frozenset("script style iframe title textarea noscript template svg".split())
#: Skipped elements that may hold another of their kind; what may stand in a head.
NESTED, HEAD = frozenset(("object",)), frozenset("base basefont bgsound link meta title style script noscript template noframes object head".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SCOPES = frozenset("table ul ol dl body html article section div main td th".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""")
_ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TAGS = (("nav", "menu"), ("header",), ("footer",), ("aside",), ("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2"), ("h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr"), ("td", "th"), ("figure", "figcaption"), ("form", "fieldset"), ("blockquote", "pre"), ("body", "html"), ("address",))
#: Attribute tokens: whole words, and beginnings of longer ones.
KINDS = {
    "text": ("article post story entry main text prose content body page single", ("articl", "content", "paragraph")),
    "menu": ("nav menu tabs pager toc crumbs links skip", ("navig", "navbar", "breadcrumb", "pagin", "menu")),
    "ad": ("ad ads adv advert promo banner sponsor dfp", ("advert", "sponsor", "promo", "adslot", "outbrain", "taboola")),
    "side": ("aside side rail widget share social tags tag related more popular complementary author bio", ("sidebar", "recommend", "widget", "trending", "related")),
    "notice": ("cookie notice consent popup modal alert gdpr overlay warning toast paywall", ("cookie", "subscri", "newslett", "notif", "consent")),
    "edge": ("footer header head foot masthead copyright legal site top bottom contentinfo colophon logo brand", ("footer", "header", "masthead", "copyright")),
    "comment": ("comment comments reply replies respond discussion disqus feedback", ("comment", "repl", "discuss")),
    "form": ("form search login signup contact", ("search", "login", "register")),
}


class Node:
    __slots__ = ("tag", "kinds", "parent", "depth", "children", "label", "own", "text", "links", "tags", "marks", "paragraphs", "words")

    def __init__(self, tag: str, kinds: frozenset, parent: int, depth: int, label: int | None):
        self.tag, self.kinds, self.parent, self.depth, self.label = tag, kinds, parent, depth, label
        self.children: list[int] = []
        self.own = self.text = self.links = self.tags = self.marks = self.paragraphs = self.words = 0


@lru_cache(4096)
def kinds_of(attributes: str) -> frozenset:
    found = set()
    for _, value in _ATTR.findall(attributes):
        for token in map(str.lower, _TOKENS.findall(value)):
            for kind, (whole, begins) in KINDS.items():
                if token in whole.split() or token.startswith(begins):
                    found.add(kind)
    return frozenset(found)


class Scanner:
    """Tags of a page in order. Comments and declarations are passed by; what has no end runs to the page's end or is text.

    An end that isn't there is looked for once, so that a page of openings without ends takes linear time.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.missing: set[str] = set()

    def end(self, mark: str, at: int) -> int:
        """The place behind the next mark, or -1."""
        if mark in self.missing:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.missing.add(mark)
            return -1
        return found + len(mark)

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Where the next markup begins and ends, and its match if it is a tag; the page's end if there is none."""
        page, n = self.page, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0:
                return n, n, None
            follows = page[start + 1 : start + 2]
            if follows in ("!", "?"):
                if page.startswith("<!--", start):
                    end = self.end("-->", start + 4)
                    return start, n if end < 0 else end, None
                end = self.end("]]>", start + 9) if page.startswith("<![CDATA[", start) else -1
                end = end if end >= 0 else self.end(">", start)
                if end >= 0:
                    return start, end, None
            elif start < self.last and (follows == "/" or follows.isalpha()) and (m := _TAG.match(page, start)):
                return start, m.end(), m
            at = start + 1

    def close(self, name: str, at: int) -> int:
        """The place behind the next end tag of a name, or the page's end."""
        found = re.compile(rf"</{name}\b", re.I).search(self.page, at)
        end = self.end(">", found.end()) if found else -1
        return len(self.page) if end < 0 else end


def closed_tags(page: str, name: str) -> set[int]:
    """Places of the start tags of a name that have an end tag of their own."""
    open_, found = [], set()
    for m in re.finditer(rf"<(/?){name}(?![a-zA-Z0-9:-])", page, re.I):
        if m[1]:
            if open_:
                found.add(open_.pop())
        else:
            if name not in NESTED:
                open_.clear()
            open_.append(m.start())
    return found


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements, the root first, and text blocks (element, text) in page order."""
    nodes = [Node("html", frozenset(), -1, 0, None)]
    stack, blocks, pending = [0], [], []
    links, at, n = 0, 0, len(page)  # within a link
    hidden: list[tuple[str, int, bool]] = []  # open skipped elements: name, elements open around it, whether it has an end tag
    closed: dict[str, set[int]] = {}
    scanner = Scanner(page)

    def leave() -> None:
        """Skipped elements end with what is around them."""
        while hidden and len(stack) < hidden[-1][1]:
            hidden.pop()

    def flush() -> None:
        if pending:
            text = " ".join("".join([t for t, _ in pending]).split())
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.words += text.count(" ") + 1
                node.marks += text.count(",") + text.count(".") + text.count(";")
                node.links += min(len(text), sum([len(t.strip()) for t, link in pending if link]))
                blocks.append((stack[-1], text))
            pending.clear()

    while at < n:
        start, end, m = scanner.next(at)
        if start > at and not hidden:
            pending.append((html.unescape(page[at:start]), links > 0))
        at = end
        if not m:
            continue
        name = m[2] or m[5]
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if hidden and not closing and hidden[-1][0] == "head" and name not in HEAD:
            hidden.pop()
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                at = scanner.close(name, at)
            continue
        if name in SKIPPED:
            names = [x for x, _, _ in hidden]
            if name in names and (closing or name not in NESTED):
                del hidden[len(names) - 1 - names[::-1].index(name) :]
                if name == "select":  # a select within a select is the end of it
                    continue
            if not closing:
                if name not in closed:
                    closed[name] = closed_tags(page, name)
                hidden.append((name, len(stack), name == "head" or start in closed[name]))
            continue
        if name == "body" or name == "html":
            hidden.clear()
            if name == "html":
                continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        if name in VOID:
            if name in ("br", "hr", "img"):
                pending.append((" ", False))
            if name == "hr":
                flush()
            nodes[stack[-1]].tags += 1
            continue
        flush()
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == name:
                    del stack[i:]
                    leave()
                    break
            continue
        while name in P_ENDS and hidden and not hidden[-1][2]:
            hidden.pop()
        if name in P_ENDS and nodes[stack[-1]].tag == "p" and not (hidden and len(stack) <= hidden[-1][1]):
            stack.pop()
        for kind in ENDS.get(name, ()):
            for i in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[i]].tag
                if tag == kind:
                    del stack[i:]
                    break
                if tag in SCOPES and tag != kind:
                    break
        leave()
        label = _LABEL.search(attributes) if "data-y" in attributes else None
        node = Node(name, kinds_of(attributes) if attributes else frozenset(), stack[-1], len(stack), int(label[1]) if label else None)
        nodes[stack[-1]].children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(node)
        if attributes.endswith("/") and name not in P_ENDS:
            stack.pop()
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.text += node.own
        node.tags += 1
        node.paragraphs += node.tag == "p" and node.own > 0
        if node.parent >= 0:
            up = nodes[node.parent]
            for field in ("text", "links", "tags", "marks", "paragraphs", "words"):
                setattr(up, field, getattr(up, field) + getattr(node, field))
    return nodes, blocks


_TAG_AT = {tag: i for i, group in enumerate(TAGS) for tag in group}
_KIND_AT = {kind: i for i, kind in enumerate(KINDS)}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element."""
    k, t = len(KINDS), len(TAGS)
    out = np.zeros((len(nodes), t + 3 * k + 22), np.float32)
    whole = max(1, nodes[0].text)
    above = np.zeros((len(nodes), k + 5), np.float32)  # kinds and tags of the ancestors
    places = {c: (i, len(p.children), nodes[p.children[i - 1]] if i else None) for p in nodes for i, c in enumerate(p.children)}
    for i, n in enumerate(nodes):
        row = out[i]
        if n.tag in _TAG_AT:
            row[_TAG_AT[n.tag]] = 1
        for kind in n.kinds:
            row[t + _KIND_AT[kind]] = 1
        if n.parent >= 0:
            up = nodes[n.parent]
            above[i] = above[n.parent]
            for kind in up.kinds:
                above[i, _KIND_AT[kind]] = 1
                row[t + k + _KIND_AT[kind]] = 1
            for j, tags in enumerate((("article", "main"), ("nav", "menu", "ul", "ol"), ("footer", "header"), ("aside",), ("form",))):
                if up.tag in tags:
                    above[i, k + j] = 1
        row[t + 2 * k : t + 3 * k + 5] = above[i]
        place, count, before = places.get(i, (0, 1, None))
        text = max(1, n.text)
        up = nodes[n.parent] if n.parent >= 0 else n
        row[t + 3 * k + 5 :] = (
            n.depth, place, count, place / count, np.log1p(n.text), np.log1p(n.own), n.links / text, n.tags / text * 100, n.marks / text * 100, min(n.paragraphs, 20), text / whole, text / max(1, up.text),
            n.words / text, text / max(1, n.words), len(n.children), before is not None and before.text > 200, up.paragraphs,
        )
    return out


class Trees:
    """Gradient-boosted trees of fixed depth for two classes, by histograms of quantiles."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.2, bins: int = 24):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold of inner nodes; leaves
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        width = self.bins + 1
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)
        flat = binned + np.arange(x.shape[1]) * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(len(y), np.int64)
            inner = (1 << self.depth) - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows) >= 8:
                    size = x.shape[1] * width
                    gs = np.bincount(flat[rows].ravel(), np.repeat(g[rows], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                    hs = np.bincount(flat[rows].ravel(), np.repeat(h[rows], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                    total, weight = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs + 1) - total**2 / (weight + 1)
                    gain[(hs < 0.5) | (weight - hs < 0.5)] = 0
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-3 and b < len(edges[j]):
                        feature[node], threshold[node] = j, edges[j][b]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            leaf = at - inner
            leaves = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            f += leaves[leaf]
            self.trees.append((feature, threshold, leaves))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, threshold, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaves[at - inner]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which elements stay: a dropped one's descendants drop, and the total of weighted log-odds is greatest. Form elements drop."""
    n = len(nodes)
    keep, drop = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        own = float(odds[i]) * (0.25 + np.log1p(node.own))
        drop[i] = -own + sum([drop[c] for c in node.children])
        keep[i] = own + sum([max(keep[c], drop[c]) for c in node.children])
        if node.tag in ("form", "fieldset", "nav", "menu"):
            keep[i] = -np.inf
    stays = [False] * n
    for i, node in enumerate(nodes):
        stays[i] = i == 0 or (stays[node.parent] and keep[i] > drop[i])
    return stays


def made_up_page(rng: random.Random) -> str:
    """A page whose elements say in data-y whether they belong to, or hold, the main text."""
    syllables = [rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouéöñ") + rng.choice(["", "n", "r", "s", "t"]) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        style = rng.random()
        if style < 0.15:
            return " | ".join(word() for _ in range(rng.randint(a, b)))
        if style < 0.25:
            return " ".join(word() + rng.choice(["###", "$$$", "&amp;&amp;&amp;", "!!"]) for _ in range(rng.randint(a, b)))
        if style < 0.3:
            return " ".join([word().upper()] * rng.randint(a, b))
        return " ".join((words(2, 9) + rng.choice([",", ".", ".", ";", ""])).capitalize() for _ in range(max(1, rng.randint(a, b) // 5)))

    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    attr = lambda *names: "" if rng.random() < 0.15 else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    def menu() -> str:
        items = "".join(f'<li data-y="0">{link()}</li>' for _ in range(rng.randint(2, 9)))
        return rng.choice([f'<nav data-y="0"><ul data-y="0">{items}</ul></nav>', f'<div data-y="0"{attr("menu", "main-nav", "breadcrumbs", "navbar")}><ul data-y="0">{items}</ul></div>', f'<ul data-y="0" class="menu">{items}</ul>'])

    def advert() -> str:
        return f'<{rng.choice(["div", "section", "aside"])} data-y="0" class="{rng.choice(["ad", "ads", "advert", "ad-slot", "promo", "banner", "sponsored"])}">{prose(3, 25)}</div>'

    def notice() -> str:
        return f'<div data-y="0" class="{rng.choice(["cookie-notice", "notice", "consent", "newsletter", "alert", "popup"])}"><p data-y="0">{prose(5, 30)}</p></div>'

    def header() -> str:
        return f'<header data-y="0"><div data-y="0"{attr("logo", "site-title", "brand")}>{words(1, 4)}</div>{menu() if rng.random() < 0.7 else ""}</header>'

    def footer() -> str:
        return f'<footer data-y="0">&copy; {words(1, 3)} &middot; {prose(3, 15)}{menu() if rng.random() < 0.3 else ""}</footer>' if rng.random() < 0.7 else f'<div data-y="0" class="{rng.choice(["footer", "site-footer", "copyright"])}"><p data-y="0">{prose(3, 20)}</p></div>'

    def side() -> str:
        inner = "".join(rng.choice([f'<p data-y="0">{prose(3, 20)}</p>', f'<h3 data-y="0">{words(1, 3)}</h3>', f'<ul data-y="0">{"".join(f"<li data-y=0>{link()}</li>" for _ in range(3))}</ul>'.replace("data-y=0", 'data-y="0"')]) for _ in range(rng.randint(1, 4)))
        return f'<aside data-y="0"{attr("sidebar", "widget")}>{inner}</aside>' if rng.random() < 0.5 else f'<div data-y="0" class="{rng.choice(["sidebar", "related", "widget", "share", "recommended"])}">{inner}</div>'

    def comments() -> str:
        each = "".join(f'<div data-y="0" class="{rng.choice(["comment", "reply", "c"])}"><p data-y="0">{prose(4, 50)}</p></div>' for _ in range(rng.randint(1, 5)))
        return f'<{rng.choice(["section", "div"])} data-y="0" {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "replies"])}"><h3 data-y="0">{words(1, 2)}</h3>{each}</div>'

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            inner = prose(1, 120)
            return rng.choice([f'<p data-y="1">{inner}</p>'] * 4 + [f'<p data-y="1"><b>{inner}<br>', f'<p data-y="1">{inner} {link()} {prose(1, 20)}</p>', f'<div data-y="1">{inner}</div>'])
        if kind < 0.78:
            return f'<{(h := rng.choice(["h2", "h3"]))} data-y="1">{words(1, 8)}</{h}>'
        if kind < 0.84:
            return '<ul data-y="1">' + "".join(f'<li data-y="1">{prose(2, 20)}</li>' for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind < 0.88:
            return f'<blockquote data-y="1"><p data-y="1">{prose(5, 40)}</p></blockquote>'
        if kind < 0.91:
            return f'<pre data-y="1">{prose(5, 40)}</pre>'
        if kind < 0.94:
            return '<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{words(1, 4)}</td><td data-y="1">{words(1, 4)}</td></tr>' for _ in range(rng.randint(1, 4))) + "</table>"
        return advert() if kind < 0.97 else rng.choice([side, notice])()

    title = f'<h1 data-y="1">{words(1, 10)}</h1>'
    if rng.random() < 0.2:
        title = f'<header data-y="1">{title}</header>'
    body = (title if rng.random() < 0.9 else "") + "".join(block() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15])))
    if 'data-y="1"' not in body:
        body = f'<p data-y="1">{prose(1, 60)}</p>'
    if rng.random() < 0.2:
        body += comments()
    wrap = rng.choice(["article", "article", "main", "div", "section", "none"])
    if wrap != "none":
        body = f'<{wrap} data-y="1"{attr("content", "post", "article-body", "entry", "story", "wrap") if wrap in ("div", "section") or rng.random() < 0.3 else ""}>{body}</{wrap}>'
    if rng.random() < 0.3:
        body = f'<div data-y="1"{attr("container", "wrapper", "row", "page")}>{body}{side() if rng.random() < 0.4 else ""}</div>'
    before = "".join(f() for f in (header, menu, notice, advert, side) if rng.random() < 0.4)
    after = "".join(f() for f in (side, comments, advert, menu, notice) if rng.random() < 0.25)
    return f'<body data-y="1">{before}{body}{after}{footer() if rng.random() < 0.8 else ""}</body>'


@lru_cache(1)
def model(pages: int = 700, seed: int = 4) -> Trees:
    """The trees, fitted on `pages` made-up pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, _ = parse(made_up_page(rng))
        known = [i for i, n in enumerate(nodes) if n.label is not None]
        xs.append(features(nodes)[known])
        ys.append([nodes[i].label for i in known])
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    odds = trees.odds(np.concatenate([features(nodes) for nodes, _ in parsed])) if parsed else []
    out, at = [], 0
    for nodes, blocks in parsed:
        stays = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join([text for i, text in blocks if stays[i]]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    trees = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = main_texts(part["html"].to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
