"""The main text of web pages, by a tree-structured graphical model over their elements.

A page is read into a tree: block elements are inner nodes, runs of inline text are leaves (the blocks of the output).
Each node is main content or not. A node's own potential is a weighted sum of what it is (tag, words of its class and id,
amount of text, share of links, marks of sentences); a table of four numbers connects each child with its parent. Messages
are passed upward from the leaves and downward from the root (sum-product), which gives each leaf's exact marginal; blocks
of at least one half are the text. All trees of a batch are passed through together, a depth at a time.

The weights are learned from labelled pages: those that mark their article themselves (`article`, `main`). Their text is
also put into other markup, with menus, notices, comments and so on around it, so that the model doesn't lean on the very
tags that gave the labels. The penalised likelihood, which the same messages give, is fitted on at most PAGES pages of at
most LENGTH characters each; with none, the weights are the penalty's centre (PRIOR). Every page is read whole.

Defined cases: a null or empty page gives empty text, as does one without any block that is content; repeated rows give
equal rows, a null id and url stay null; what an unclosed tag, comment or script has cut off is not text; reading takes
time in proportion to the length, and elements nested deeper than DEPTH count as children of the one there; an empty
table gives an empty result; only the id, url and html are read, so other columns' names can't clash.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import columns_of

#: The most pages that the weights are learned from, their greatest length, and how many other markups each is put into.
PAGES, LENGTH, MARKUPS = 400, 200_000, 3
DEPTH = 200

# Elements by what they do with text, and words of class and id attributes by what they tell.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input meta link base area embed source track param col html head body".split())
DROPPED = set("script style noscript template textarea select button svg iframe object canvas audio video title math".split())
RAW = set("script style textarea title".split())
ENDS_P = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead")}
TAGS = {
    "article": "article main", "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside", "form": "form fieldset dialog", "p": "p", "h1": "h1", "h": "h2 h3 h4 h5 h6",
    "list": "ul ol dl", "item": "li dt dd", "table": "table tbody thead tfoot tr td th", "quote": "blockquote pre figure figcaption address", "box": "div section center details summary",
}
WORDS = {
    "content": "content article post entry story main text prose articlebody maincontent hentry body",
    "comment": "comment comments commentlist reply replies disqus respond discussion responses feedback reactions",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs topnav subnav skip",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp commercial adbox",
    "side": "sidebar side aside widget related recommended recommendations rail trending popular teaser more",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead topbar brand logo top branding",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup privacy paywall warning message login",
    "share": "share sharing social follow tags meta byline tools print rating",
    "form": "form search searchbox searchform contact",
}
#: Elements of running text; they, their leaves and other elements have edges of their own.
TEXTUAL = ("p", "h1", "h", "item", "list", "quote")
#: Elements that tell what all inside them is.
LANDMARKS = ("article", "nav", "header", "footer", "aside", "form")
TAG_OF = {t: g for g, ts in TAGS.items() for t in ts.split()}
WORD_OF = {w: g for g, ws in WORDS.items() for w in ws.split()}
SIZES, SHARES, PARTS = (3, 6, 12, 25, 50), (0.001, 0.34, 0.8), (0.05, 0.25, 0.6)

#: Names of the features; all are there or not.
NAMES = [
    "leaf", "element", "root", *[f"tag-{t}" for t in [*TAGS, "other"]], *[f"word-{w}" for w in WORDS], "hidden", *[f"leaf-size-{k}" for k in range(6)], *[f"leaf-links-{k}" for k in range(4)],
    *[f"under-{t}" for t in LANDMARKS], "leaf-ends", "leaf-marks", "leaf-legal", *[f"leaf-in-{t}" for t in [*TAGS, "other", "root"]], *[f"part-size-{k}" for k in range(6)], *[f"part-links-{k}" for k in range(4)], *[f"part-share-{k}" for k in range(4)], *[f"part-mean-{k}" for k in range(6)],
]
AT = {n: k for k, n in enumerate(NAMES)}
#: Where the penalty pulls the weights to, and with which strength; other weights are pulled to 0.
PRIOR = {"tag-article": 1, "tag-nav": -3, "tag-footer": -3, "tag-aside": -2, "tag-form": -2, "tag-header": -1, "word-content": 1, "hidden": -2, "leaf-size-4": 0.5, "leaf-size-5": 1, "leaf-ends": 0.5, "leaf-links-3": -1, "leaf-legal": -1, "part-links-3": -1} | {f"word-{w}": -2 for w in WORDS if w != "content"}
PULL = 0.02

TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?--!?>|.*)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z)|[!?/][^>]*>?)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|itemprop)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CAMEL, OTHER = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-z]+")
LEGAL, MARKS, LAST = re.compile(r"©|copyright|all rights reserved|cookie", re.I), re.compile(r"[.!?;:,。！？](?:\s|$)"), re.compile(r"[.!?…。！？:][\"'”’»)\]]*$")


@dataclass
class Tree:
    """A page's nodes in page order, parents first: for each its parent, depth, features and, of leaves, the text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: ["root"])
    groups: list[frozenset] = field(default_factory=lambda: [frozenset()])
    text: list[str | None] = field(default_factory=lambda: [None])
    links: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, groups: frozenset = frozenset(), text: str | None = None, links: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tags.append(tag)
        self.groups.append(groups)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def groups_of(attributes: str) -> frozenset:
    """What the attributes of a tag tell of it."""
    out = set()
    for name, *values in NAMED.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("hidden")
        elif name != "style":
            out.update(WORD_OF[w] for w in OTHER.split(CAMEL.sub(" ", value).lower()) if w in WORD_OF)
    return frozenset(out)


def read(page: str) -> Tree:
    """The tree of a page. Tags that are missing are taken as HTML has them: a block ends a paragraph, a list item the
    one before, and the end of an element all that are open inside it."""
    tree, stack, names, opened = Tree(), [0], ["root"], {}
    buffer: list[str] = []
    linked, inside, pos, absent = 0, False, 0, set()

    def block() -> None:
        nonlocal linked, inside
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tree.add(stack[min(len(stack), DEPTH) - 1], "leaf", text=text, links=min(linked, len(text)))
            buffer.clear()
        linked, inside = 0, False

    def pop() -> None:
        opened[names.pop()] -= 1
        stack.pop()

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            buffer.append(text)
            if inside:
                linked += len(text.strip())

    while (m := TOKEN.search(page, pos)) is not None:
        say(page[pos : m.start()])
        pos = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                inside = False
            elif name == "br":
                buffer.append(" ")
            elif name == "p" and not opened.get("p"):
                block()
            elif opened.get(name):
                block()
                while names[-1] != name:
                    pop()
                pop()
            continue
        if name in DROPPED and not m[3].endswith("/"):
            end = None if name in absent else re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            if end is not None:
                pos = end.end()
            elif name in RAW:  # it goes on to the end
                pos = len(page)
            else:
                absent.add(name)
        elif name == "br":
            buffer.append(" ")
        elif name == "hr":
            block()
        elif name == "a":
            inside = True
        elif name not in INLINE and name not in DROPPED:
            block()
            if names[-1] == "p":
                pop()
            for closed in ENDS_P.get(name, ()):
                if names[-1] == closed:
                    pop()
            stack.append(tree.add(stack[min(len(stack), DEPTH) - 1], name, groups_of(m[3])))
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
    say(page[pos:])
    block()
    return tree


def step(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def features(tree: Tree) -> list[list[int]]:
    """The features of each node."""
    n = len(tree.parent)
    words, chars, links, leaves, out, under = [0] * n, [0] * n, [0] * n, [0] * n, [], [None] * n
    for k in range(n - 1, 0, -1):
        if (text := tree.text[k]) is not None:
            words[k], chars[k], links[k], leaves[k] = text.count(" ") + 1, len(text), tree.links[k], 1
        p = tree.parent[k]
        words[p] += words[k]
        chars[p] += chars[k]
        links[p] += links[k]
        leaves[p] += leaves[k]
    for k in range(n):
        share = links[k] / max(chars[k], 1)
        if (text := tree.text[k]) is None:
            f = [AT["element"], AT["root"] if k == 0 else AT["tag-" + TAG_OF.get(tree.tags[k], "other")], *[AT[g if g == "hidden" else "word-" + g] for g in tree.groups[k]]]
            f += [AT[f"part-size-{step(words[k], SIZES)}"], AT[f"part-links-{step(share, SHARES)}"], AT[f"part-share-{step(words[k] / max(words[0], 1), PARTS)}"], AT[f"part-mean-{step(words[k] / max(leaves[k], 1), SIZES)}"]]
        else:
            above = tree.parent[k]
            f = [AT["leaf"], AT[f"leaf-size-{step(words[k], SIZES)}"], AT[f"leaf-links-{step(share, SHARES)}"], AT["leaf-in-root" if above == 0 else "leaf-in-" + TAG_OF.get(tree.tags[above], "other")]]
            if LAST.search(text, max(0, len(text) - 8)):
                f.append(AT["leaf-ends"])
            if MARKS.search(text):
                f.append(AT["leaf-marks"])
            if len(text) < 400 and LEGAL.search(text):
                f.append(AT["leaf-legal"])
        if k:
            group = TAG_OF.get(tree.tags[tree.parent[k]])
            under[k] = group if group in LANDMARKS else under[tree.parent[k]]
        out.append(f if under[k] is None else [*f, AT["under-" + under[k]]])
    return out


class Forest:
    """The trees of several pages as arrays."""

    def __init__(self, trees: list[Tree]):
        starts = np.cumsum([0, *[len(t.parent) for t in trees]])
        self.parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, starts, strict=False)] or [np.zeros(0, int)])
        depth = np.concatenate([np.array(t.depth) for t in trees] or [np.zeros(0, int)])
        self.starts, self.kind = starts, np.array([2 if x is not None else int(TAG_OF.get(g) in TEXTUAL) for t in trees for x, g in zip(t.text, t.tags, strict=True)], int)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        each = [f for t in trees for f in features(t)]
        self.node = np.repeat(np.arange(len(each)), [len(f) for f in each])
        self.feature = np.array([x for f in each for x in f], int)


def sum_product(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each node's probability of being content, the expected edges by (kind of child, parent, child))."""
    n = len(forest.parent)
    up, belief = np.zeros((n, 2)), np.zeros((n, 2))
    up[:, 1] = np.bincount(forest.node, weights[forest.feature], n)
    to_parent = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:  # from the leaves
        t = edges[forest.kind[level]]
        to_parent[level] = np.logaddexp(up[level, None, 0] + t[:, :, 0], up[level, None, 1] + t[:, :, 1])
        for y in (0, 1):
            up[:, y] += np.bincount(forest.parent[level], to_parent[level, y], n)
    expected = np.zeros((3, 2, 2))
    for k, level in enumerate(forest.levels):  # from the roots
        if k == 0:
            belief[level] = up[level]
            continue
        t, rest = edges[forest.kind[level]], belief[forest.parent[level]] - to_parent[level]
        belief[level] = up[level] + np.logaddexp(rest[:, 0, None] + t[:, 0], rest[:, 1, None] + t[:, 1])
        both = rest[:, :, None] + t + up[level][:, None, :]
        both = np.exp(both - both.max((1, 2), keepdims=True))
        both /= both.sum((1, 2), keepdims=True)
        for kind in range(3):
            expected[kind] += both[forest.kind[level] == kind].sum(0)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), expected


@dataclass
class Model:
    weights: np.ndarray
    edges: np.ndarray

    def text(self, pages: list[str | None]) -> list[str]:
        trees = [read(p or "") for p in pages]
        forest = Forest(trees)
        good = sum_product(forest, self.weights, self.edges)[0] >= 0.5
        return ["\n\n".join(x for x, g in zip(t.text, good[s : s + len(t.text)], strict=True) if x is not None and g) for t, s in zip(trees, forest.starts, strict=False)]


def inner_labels(tree: Tree, y: list[int]) -> list[int]:
    """Labels of all nodes from those of the leaves: an element is what most of its words are."""
    good, every = [0] * len(y), [0] * len(y)
    for k in range(len(y) - 1, -1, -1):
        if tree.text[k] is not None:
            every[k] = tree.text[k].count(" ") + 1
            good[k] = every[k] * y[k]
        if k:
            good[tree.parent[k]] += good[k]
            every[tree.parent[k]] += every[k]
    return [int(2 * g > e) for g, e in zip(good, every, strict=True)]


def labels_of(tree: Tree) -> list[int] | None:
    """The labels that a page gives itself by its article or main element; None if it has none, or nothing around it."""
    state = [0] * len(tree.parent)  # 0: outside, 1: content, 2: not content, whatever holds it
    for k in range(1, len(state)):
        state[k], group = state[tree.parent[k]], TAG_OF.get(tree.tags[k])
        if group in ("nav", "footer", "aside", "form") or tree.groups[k] - {"content", "head", "share"}:
            state[k] = 2
        elif group == "article" and state[k] == 0:
            state[k] = 1
    y = [int(s == 1) for s in state]
    kinds = {a for a, t in zip(y, tree.text, strict=True) if t is not None}
    return inner_labels(tree, y) if kinds == {0, 1} else None


def redress(tree: Tree, y: list[int], rng: random.Random) -> tuple[Tree, list[int]]:
    """The page's text in other markup, with its labels."""
    e = entities.escape
    body = [(tree.tags[tree.parent[k]], t) for k, t in enumerate(tree.text) if t is not None and y[k]]
    other = [t for k, t in enumerate(tree.text) if t is not None and not y[k]] or ["Home"]
    words = " ".join(t for _, t in body).split()
    if rng.random() < 0.2:  # a short article
        body = [(tag, " ".join(t.split()[: rng.randint(1, 12)]).rstrip(",;:") + rng.choice(["", ".", "."])) for tag, t in body[: rng.randint(1, 3)]]

    def some(least: int, most: int) -> str:
        at = rng.randrange(max(1, len(words) - most))
        return " ".join(words[at : at + rng.randint(least, most)]) or "Home"

    parts, told = [], []

    def put(html: str, *labels: int) -> None:
        parts.append(html)
        told.extend(labels)

    def listed(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{e(some(1, 3))}</a></li>' for _ in range(n)) + "</ul>"

    def wrapped(choices: str, inner: str, *labels: int) -> None:
        start = rng.choice(choices.split("|"))
        put(f"<{start}>{inner}</{start.split()[0]}>", *labels)

    def sometimes(share: float) -> bool:
        return rng.random() < share

    neutral = "div|div class=c1|section|div id=x|div class=row|div class=wrap"
    aside = lambda: wrapped("aside|div class=sidebar|div id=side-bar|div class='widget related'|section class=recommended|div class=col-side", f"<h3>{e(some(1, 3))}</h3>{listed(4)}<p>{e(rng.choice([some(3, 20), *other]))}</p>", *[0] * 6)
    if sometimes(0.6):
        wrapped("header|div class=header|div id=masthead|div class=top-bar", f"<div>{e(some(1, 3))}</div><p>{e(some(2, 6))}</p>", 0, 0)
    if sometimes(0.8):
        n = rng.randint(3, 8)
        wrapped("nav|div class=menu|div id=nav|div class=nav-bar|div class=breadcrumbs|" + neutral, listed(n), *[0] * n)
    if sometimes(0.4):
        wrapped("div class=cookie-consent|div id=gdpr|div class=notice|div class=newsletter-popup|div role=alert class=message", f"<p>{e(some(5, 25))}</p>", 0)
    if sometimes(0.5):
        wrapped("div class=ad|div class=adbox|div id=banner|div class=sponsored|aside", f"{e(rng.choice([some(3, 25), *other]))}", 0)
    if sometimes(0.3):
        aside()
    outer = [rng.choice(("article|main|div class=content|div id=main-content|div class=post|div class='entry-content'|div class=article-body|div role=main class=story|" + neutral).split("|")) for _ in range(rng.randint(1, 3))]
    put("".join(f"<{x}>" for x in outer))
    if sometimes(0.3):
        put("<header>")
    head = len(parts) and parts[-1] == "<header>"
    for k, (tag, t) in enumerate(body):
        tag = "h1" if tag == "h1" else rng.choice(["p"] * 8 + ["div", "blockquote", "h2" if len(t) < 60 else "p"])
        put(f"<{tag}>{e(t)}</{tag}>", 1)
        if k == 0 and head:
            put("</header>")
        if k == 0 and sometimes(0.2):
            wrapped("div class=byline|div class=meta|p class=post-meta|div class=share|ul class=social", e(some(2, 6)), 0)
        if k and sometimes(0.03):
            wrapped("div class=ad|div class=advert|aside|div class=related|div class=promo", e(some(3, 25)), 0)
    if sometimes(0.15):
        n = rng.randint(2, 5)
        put("<ul>" + "".join(f"<li>{e(some(2, 12))}</li>" for _ in range(n)) + "</ul>", *[1] * n)
    inside = sometimes(0.3)
    if not inside:
        put("".join(f"</{x.split()[0]}>" for x in reversed(outer)))
    if sometimes(0.2):
        wrapped("div class=share|div class=social|div class=tags|ul class=share-tools", e(some(2, 6)), 0)
    if sometimes(0.6):
        n, shape = rng.randint(1, 6), rng.choice(["<div class=comment><b>{a}</b><p>{t}</p></div>", "<li class=comment><p>{t}</p></li>", "<p>{t}</p>", "<article class=comment-body><p>{t}</p></article>", "<div class=reply>{t}</div>"])
        said = [shape.format(a=e(some(1, 2)), t=e(some(4, 60))) for _ in range(n)]
        wrapped("div class=comments|section id=comments|ol class=comment-list|div id=disqus_thread|div class=discussion|section class=responses", f"<h3>{e(some(1, 3))}</h3>" + "".join(said), 0, *[0] * (n * (2 if "<b>" in shape else 1)))
    if inside:
        put("".join(f"</{x.split()[0]}>" for x in reversed(outer)))
    if sometimes(0.4):
        aside()
    if sometimes(0.4):
        wrapped("form|form class=search|div class=subscribe-form|form id=contact", f"<p>{e(some(2, 15))}</p><label>{e(some(1, 2))}</label><input name=q>", 0, 0)
    if sometimes(0.85):
        wrapped("footer|div class=footer|div id=footer|div class=copyright|div class=bottom", f"<p>{e(rng.choice(['&copy; ' + some(1, 3), some(3, 25), *other]))}</p>{listed(2)}", 0, 0, 0)
    made = read("".join(parts))
    leaves = [k for k, t in enumerate(made.text) if t is not None]
    if len(leaves) != len(told):  # text that isn't a block of its own, such as a text of no words
        return tree, y
    z = [0] * len(made.parent)
    for k, label in zip(leaves, told, strict=True):
        z[k] = label
    return made, inner_labels(made, z)


def start() -> Model:
    """The centre of the penalty, and edges that hold parent and child alike."""
    w = np.zeros(len(NAMES))
    for name, x in PRIOR.items():
        w[AT[name]] = x
    return Model(w, np.array([[[1.0, -1.0], [-1.0, 1.0]]] * 3))


def learn(pages: list[tuple[Tree, list[int]]], steps: int = 150, rate: float = 0.1) -> Model:
    """The weights under which the labels are likeliest, less the penalty (gradient steps by Adam)."""
    centre = start()
    if not pages:
        return centre
    forest, y = Forest([t for t, _ in pages]), np.array([v for _, z in pages for v in z])
    n, inner = len(NAMES), forest.parent >= 0
    inner[forest.starts[:-1]] = False
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    have = np.bincount(forest.feature, y[forest.node], n)
    at = np.concatenate([centre.weights, centre.edges.ravel()])
    now, m, v = at.copy(), np.zeros(len(at)), np.zeros(len(at))
    for k in range(1, steps + 1):
        p, expected = sum_product(forest, now[:n], now[n:].reshape(3, 2, 2))
        g = np.concatenate([np.bincount(forest.feature, p[forest.node], n) - have, (expected - seen).ravel()]) / len(pages) + PULL * (now - at)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        now -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(now[:n], now[n:].reshape(3, 2, 2))


def fit(pages: DataFrame, most: int = PAGES, length: int = LENGTH, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The model of the pages that label themselves; which of them are taken depends on ids and texts alone."""
    h = F.col(f"`{html_col}`")
    own = pages.select(h.alias("h"), F.xxhash64(F.col(f"`{id_col}`"), h).alias("o")).where((F.length("h") <= length) & F.col("h").rlike("(?i)<(article|main)[\\s>]"))
    # hashes first, so that not each task sends its first pages to the driver; repeated rows count once
    last = own.select("o").orderBy("o").limit(most).agg(F.max("o")).first()[0]
    picked = own.where(F.col("o") <= F.lit(last)).distinct().orderBy("o", "h").limit(most).toPandas()
    out = []
    for page, o in zip(picked["h"], picked["o"], strict=True):
        tree = read(page)
        if (y := labels_of(tree)) is not None:
            rng = random.Random(int(o))
            out += [(tree, y), *[redress(tree, y, rng) for _ in range(MARKUPS)]]
    return learn(out)


def extract_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): each page's main text; without a model, by one of these pages."""
    model = fit(pages, id_col=id_col, html_col=html_col) if model is None else model
    rows = pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)])
    schema = StructType([*rows.schema.fields[:2], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in columns_of(batches, rows=500, size=2 << 20):
            texts = model.text(b.column(2).to_pylist())
            made = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
