"""Main text of web pages by a tree-structured graphical model.

The nodes are the block elements of the page. Each carries features of its own (tag, words of its class and id, length,
punctuation and link density of its text and of its subtree) and a potential with its parent, one matrix for each kind of
child. Sum-product messages go up from the leaves and down again, which gives the exact marginal probability that a node
is content. Weights are fitted by gradient ascent on the likelihood of labelled pages; those are composed here, from
layouts of articles, menus, headers, sidebars, notices, adverts, forms, footers and reader comments.

The messages run over many pages at once, one tree level at a time.

The text of a page is that of its content blocks in page order: character references decoded, white space inside a block
one space, trimmed, blocks joined by a line feed. Text inside inline elements belongs to the block around them.

Defined results: null, empty or text-free html gives an empty text; unclosed, misnested and stray tags are taken as
browsers do in the common cases (a block start ends an open paragraph, list items and cells end one another, a stray end
tag is ignored); equal rows give equal results; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table

# a tag ends before the next < outside quotes, so no start of a tag is tried over the whole rest of a page
_token = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|title|math|object|canvas)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_named = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_space = re.compile(r"\s+")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend address details summary dialog center hr menu search hgroup".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
ENDS_P = BLOCKS - {"html", "body"}
#: An opening tag ends the nearest of these, unless one of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
#: Words of class, id and role, by what they tell.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
    "head": "header masthead topbar logo branding banner hero",
    "foot": "footer copyright legal colophon bottom",
    "side": "sidebar aside side widget rail related recommended popular trending more tags",
    "note": "cookie cookies consent notice notices alert popup modal overlay gdpr privacy message warning announcement newsletter subscribe paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola",
    "form": "form login signup search contact register",
    "talk": "comment comments commentlist reply replies respond disqus discussion reader",
    "share": "share sharing social follow facebook twitter",
    "body": "article content main post entry story text body page blog news",
}
_hint = {w: k for k, ws in HINTS.items() for w in ws.split()}
_hint_no = {k: n for n, k in enumerate(HINTS)}
TAGS = ("article", "main", "section", "div", "nav", "aside", "header", "footer", "form", "p", "h1", "h", "list", "item", "table", "cell", "quote", "body", "other")
_tag_no = {t: n for n, t in enumerate(TAGS)}
_tag_of = {
    **{t: t for t in ("article", "main", "section", "div", "nav", "aside", "header", "footer", "form", "p", "h1", "body")},
    **dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), "h"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr"), "table"), **dict.fromkeys(("td", "th", "caption"), "cell"), **dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), "quote"),
    "fieldset": "form", "search": "form", "dialog": "aside", "html": "body",
}
#: Kinds of child, each with a potential of its own.
KINDS = ("landmark", "box", "text", "row")
_kind_of = {
    **dict.fromkeys(("article", "main", "nav", "aside", "header", "footer", "form"), 0), **dict.fromkeys(("section", "div", "body", "table", "list"), 1),
    **dict.fromkeys(("p", "h1", "h", "quote", "other"), 2), **dict.fromkeys(("item", "cell"), 3),
}


class Page:
    """Block tree: parent, tag, hints of each node, and its text pieces in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.hints = [-1], ["body"], [()]
        self.pieces: list[tuple[int, int, str]] = []  # (order, node, text)
        self.links: list[int] = [0]
        stack = [0]  # open nodes
        names = ["body"]
        open_: Counter[str] = Counter()  # how many of each name are open
        in_link, in_head, hidden = 0, 0, 0
        order, done = 0, 0
        run = 0  # a new run of text begins whenever a block starts or ends

        def take(text):
            nonlocal order
            if text and not in_head and not hidden:
                self.pieces.append((run, stack[-1], text))
                if in_link:
                    self.links[stack[-1]] += len(text)

        def cut(at):
            open_.subtract(names[at:])
            del names[at:], stack[at:]

        for m in _token.finditer(source):
            if m.start() > done:
                take(source[done : m.start()])
            done = m.end()
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            if m.group(2):
                if name == "a":
                    in_link = 0
                elif name == "head":
                    in_head = 0
                elif name in BLOCKS and open_[name] > 0:
                    at = len(names) - 1
                    while names[at] != name:
                        at -= 1
                    cut(at)
                    run += 1
                    if hidden and len(stack) < hidden:
                        hidden = 0
                    if name != "p":
                        in_link = 0
                continue
            if name == "head":
                in_head = 1
                continue
            if name == "body":
                in_head = 0
            if name == "a":
                in_link = 1
                continue
            if name == "br":
                take(" ")
                continue
            if name not in BLOCKS or name in ("html", "body"):
                continue
            in_head = 0
            if name in ENDS_P and open_["p"] > 0:
                at = len(names) - 1
                while names[at] not in ("p", "td", "th", "table"):
                    at -= 1
                if names[at] == "p":
                    cut(at)
            if name in CLOSES and any(open_[x] > 0 for x in CLOSES[name][0]):
                ends, stops = CLOSES[name]
                for at in range(len(names) - 1, 0, -1):
                    if names[at] in stops:
                        break
                    if names[at] in ends:
                        cut(at)
            if hidden and len(stack) < hidden:
                hidden = 0
            run += 1
            if name in VOID:
                continue
            found = ()
            attributes = m.group(4)
            if attributes and "=" in attributes or attributes.strip() in ("hidden",):
                words = set()
                for a in _named.finditer(attributes):
                    value = a.group(2) or a.group(3) or a.group(4) or ""
                    kind = a.group(1).lower()
                    if kind == "style":
                        if _hidden.search(value) and not hidden:
                            hidden = len(stack) + 1
                    elif kind in ("hidden", "aria-hidden"):
                        if kind == "hidden" and not hidden:
                            hidden = len(stack) + 1
                    else:
                        words.update(_hint[w] for w in (x.lower() for x in _part.findall(value)) if w in _hint)
                found = tuple(_hint_no[w] for w in words)
            self.parent.append(stack[-1])
            self.tag.append(_tag_of.get(name, "other"))
            self.hints.append(found)
            self.links.append(0)
            if not m.group(0).endswith("/>"):
                stack.append(len(self.parent) - 1)
                names.append(name)
                open_[name] += 1
        if done < len(source):
            take(source[done:])

    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of every run of text, white space folded, in page order."""
        out, run, node, parts = [], None, None, []
        for r, n, t in [*self.pieces, (None, None, "")]:
            if (r, n) != (run, node):
                if parts:
                    text = _space.sub(" ", html.unescape("".join(parts))).strip()
                    if text:
                        out.append((node, text))
                run, node, parts = r, n, []
            parts.append(t)
        return out


N_FEATURES = len(TAGS) + len(HINTS) + 12


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, in order."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1))) if len(depth) else []


def features(pages: list[Page], blocks: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, depth, kind) over the nodes of all pages, parents before children."""
    first = np.cumsum([0] + [len(p.parent) for p in pages])
    n = int(first[-1])
    parent = np.concatenate([np.array(p.parent, np.int64) + np.where(np.array(p.parent) < 0, 0, f) for p, f in zip(pages, first, strict=False)])
    tags = np.array([_tag_no[t] for p in pages for t in p.tag])
    kind = np.array([_kind_of[t] for p in pages for t in p.tag])
    x = np.zeros((n, N_FEATURES))
    x[np.arange(n), tags] = 1
    rows = [(f + k, h) for p, f in zip(pages, first, strict=False) for k, hs in enumerate(p.hints) for h in hs]
    if rows:
        at = np.array(rows)
        x[at[:, 0], len(TAGS) + at[:, 1]] = 1
    own, links, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for p, f, bs in zip(pages, first, blocks, strict=False):
        links[f : f + len(p.links)] = p.links
        for node, text in bs:
            own[f + node] += len(text)
            marks[f + node] += text.count(",") + text.count(".") + text.count(";")
    depth = np.zeros(n, np.int64)
    for k in range(n):  # parents stand before their children
        if parent[k] >= 0:
            depth[k] = depth[parent[k]] + 1
    sub, sub_links, sub_marks = own.copy(), np.minimum(links, own), marks.copy()
    for at in levels(depth)[:0:-1]:
        for a in (sub, sub_links, sub_marks):
            np.add.at(a, parent[at], a[at])
    root = np.repeat(first[:-1], np.diff(first))
    b = len(TAGS) + len(HINTS)
    x[:, b] = np.minimum(np.log1p(own), 7) / 5
    x[:, b + 1] = np.minimum(np.log1p(sub), 9) / 8
    x[:, b + 2] = np.minimum(links, own) / np.maximum(own, 1)
    x[:, b + 3] = sub_links / np.maximum(sub, 1)
    x[:, b + 4] = np.minimum(np.log1p(marks), 3) / 3
    x[:, b + 5] = np.minimum(sub_marks / np.maximum(sub, 1) * 20, 1)
    x[:, b + 6] = sub / np.maximum(sub[root], 1)
    x[:, b + 7] = own == 0
    x[:, b + 8] = (own > 0) & (own < 25)
    x[:, b + 9] = own > 80
    x[:, b + 10] = (x[:, len(TAGS) : b].sum(1) == 0) & (tags == _tag_no["div"])
    x[:, b + 11] = 1
    return x, parent, depth, kind


def marginals(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product on the forest: node marginals (n, 2), edge marginals (n, 2 parent, 2 child), log of the partition sum.

    unary (n,) is the score of label 1; pair (kinds, 2, 2) the scores of (parent, child) labels."""
    n = len(unary)
    node = np.zeros((n, 2))
    node[:, 1] = unary
    up = node.copy()  # own score and all messages from below
    send = np.zeros((n, 2))
    by_depth = levels(depth)
    for at in by_depth[:0:-1]:
        s = up[at][:, None, :] + pair[kind[at]]  # parent label, child label
        top = s.max(2)
        send[at] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        np.add.at(up, parent[at], send[at])
    total = 0.0
    down = np.zeros((n, 2))
    edge = np.zeros((n, 2, 2))
    for d, at in enumerate(by_depth):
        if d == 0:
            top = up[at].max(1)
            total = float((top + np.log(np.exp(up[at] - top[:, None]).sum(1))).sum())
            continue
        outside = up[parent[at]] + down[parent[at]] - send[at]
        s = outside[:, :, None] + pair[kind[at]] + up[at][:, None, :]
        top = s.max((1, 2), keepdims=True)
        e = np.exp(s - top)
        edge[at] = e / e.sum((1, 2), keepdims=True)
        m = outside[:, :, None] + pair[kind[at]]
        top = m.max(1)
        down[at] = top + np.log(np.exp(m - top[:, None, :]).sum(1))
    belief = up + down
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True), edge, total


class Tree:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def content(self, pages: list[Page], blocks) -> list[np.ndarray]:
        x, parent, depth, kind = features(pages, blocks)
        p, _, _ = marginals(x @ self.weights, self.pair, parent, depth, kind)
        cuts = np.cumsum([len(q.parent) for q in pages])[:-1]
        return np.split(p[:, 1], cuts)

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        blocks = [p.blocks() for p in pages]
        return ["\n".join(t for n, t in b if q[n] >= 0.5) for b, q in zip(blocks, self.content(pages, blocks), strict=True)] if pages else []


# ---- labelled pages -------------------------------------------------------------------------------------------------

_MARK = "⁠"  # stands in content text of composed pages, and nowhere else


def compose(r: random.Random) -> str:
    """A page whose content text carries _MARK."""
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    def prose(a, b):
        if r.random() < 0.08:  # no sentences at all: runs of one word, numbers, very long or very short
            return " ".join(w for _ in range(r.randint(1, 12)) for w in [r.choice([word(), str(r.randint(0, 10**6)), word() + "."])] * r.choice([1, 1, 13, 60]))
        return ". ".join((words(1, 14) + (", " + words(1, 8) if r.random() < 0.4 else "")).capitalize() for _ in range(r.randint(a, b))) + "."
    mark = lambda t: _MARK + t
    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'
    attr = lambda kind, p=0.7: (f' {r.choice(["class", "id"])}="{r.choice([r.choice(HINTS[kind].split()), r.choice(HINTS[kind].split()) + "-" + word(), word() + " " + r.choice(HINTS[kind].split())])}"' if r.random() < p else "")
    def links(tag="ul"):
        return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 12))) + f"</{tag}>"
    def inline(t):
        c = r.random()
        return f"<b>{t}" if c < 0.1 else f"<b>{t}</b>" if c < 0.2 else t + " " + link() + " " + words(2, 9) + "." if c < 0.35 else t.replace(" ", " <em>", 1) + "</em>" if c < 0.45 else t
    def paragraph():
        t = prose(1, 1) if r.random() < 0.3 else prose(1, 7)
        end = "" if r.random() < 0.2 else "</p>"
        return f"<p>{mark(inline(t))}{'<br>' if r.random() < 0.1 else ''}{end}"
    def piece():
        c = r.random()
        if c < 0.72:
            return paragraph()
        if c < 0.8:
            return f"<h{(k := r.randint(2, 4))}>{mark(words(1, 9))}</h{k}>"
        if c < 0.86:
            return "<ul>" + "".join(f"<li>{mark(inline(words(1, 14)))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if c < 0.9:
            return f"<blockquote>{r.choice(['', '<p>'])}{mark(prose(1, 3))}</blockquote>"
        if c < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{mark(words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if c < 0.95:
            return f"<figure><img src=x><figcaption>{mark(words(3, 10))}</figcaption></figure>"
        if c < 0.97:
            return f"<div{attr('ad', 1)}>{prose(1, 2)}</div>"
        return f"<div>{mark(prose(1, 4))}</div>"
    def article():
        inner = (f"<header><h1>{mark(words(3, 12))}</h1></header>" if r.random() < 0.15 else f"<h1>{mark(words(2, 14))}</h1>" if r.random() < 0.9 else "") + "".join(piece() for _ in range(r.randint(1, 14)))
        if r.random() < 0.25:
            inner = f"<div{attr('body')}>{inner}</div>"
        if r.random() < 0.1:
            inner += f"<div{attr('share', 1)}>{links()}</div>"
        if r.random() < 0.06:
            inner += f"<footer>{words(2, 8)} {link()}</footer>"
        c = r.random()
        if c < 0.5:
            return f"<article{attr('body', 0.3)}>{inner}</article>"
        if c < 0.65:
            return f"<main{attr('body', 0.3)}>{inner}</main>"
        if c < 0.9:
            return f"<div{attr('body', 1)}>{inner}</div>"
        return f"<section{attr('body', 0.8)}>{inner}</section>"
    def talk():
        n = r.randint(1, 6)
        one = lambda: r.choice([f"<p>{prose(1, 4)}</p>", f"<div{attr('talk', 0.6)}><p>{prose(1, 4)}</p></div>", prose(1, 3)])
        if r.random() < 0.5:
            body = "<ol>" + "".join(f"<li{attr('talk', 0.5)}>{one()}</li>" for _ in range(n)) + "</ol>"
        else:
            body = "".join(f"<div{attr('talk', 0.8)}>{one()}</div>" for _ in range(n))
        return f"<{(t := r.choice(['section', 'div', 'div', 'aside']))}{attr('talk', 1)}>" + (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.6 else "") + body + f"</{t}>"
    def form():
        t = f"<form action=/x><label>{words(1, 4)}</label><input><button>{words(1, 2)}</button><p>{prose(1, 2)}</p></form>"
        return f"<div{attr('form', 1)}>{t}</div>" if r.random() < 0.4 else t
    notice = lambda: f"<div{attr('note', 1)}>{r.choice(['', '<p>'])}{prose(1, 4)}{r.choice(['', link()])}</div>"
    advert = lambda: f"<{(t := r.choice(['div', 'div', 'aside', 'section']))}{attr('ad', 1)}>{r.choice(['', '<p>'])}{prose(1, 4)}</{t}>"
    menu = lambda: r.choice([f"<nav{attr('menu', 0.3)}>{links()}</nav>", f"<div{attr('menu', 1)}>{links()}</div>", f"<ul{attr('menu', 1)}>" + "".join(f"<li>{link()}</li>" for _ in range(6)) + "</ul>"])
    head = lambda: r.choice([f"<header{attr('head', 0.4)}>{r.choice([words(1, 5), '<h2>' + words(1, 5) + '</h2>', prose(1, 1)])}{r.choice(['', links()])}</header>", f"<div{attr('head', 1)}>{words(1, 6)}</div>"])
    foot = lambda: r.choice([f"<footer{attr('foot', 0.3)}>&copy; {word()}.example &middot; {prose(1, 3)}</footer>", f"<footer>{links()}<p>{prose(1, 2)}</p></footer>", f"<div{attr('foot', 1)}>{prose(1, 2)}{link()}</div>"])
    side = lambda: f"<{(t := r.choice(['aside', 'aside', 'div']))}{attr('side', 1 if t == 'div' else 0.5)}><h3>{words(1, 3)}</h3>{r.choice([links(), '<p>' + prose(1, 4) + '</p>', links() + '<p>' + prose(1, 2)])}</{t}>"
    before = [f() for f, p in ((notice, 0.3), (head, 0.4), (menu, 0.85), (advert, 0.5), (side, 0.25), (form, 0.15)) if r.random() < p]
    after = [f() for f, p in ((talk, 0.4), (side, 0.35), (advert, 0.25), (form, 0.25), (notice, 0.2), (menu, 0.15), (foot, 0.85)) if r.random() < p]
    middle = article()
    if r.random() < 0.3:
        middle = f"<div{attr('body', 0.4)}>{middle}{talk() if r.random() < 0.3 else ''}</div>"
    body = "".join(before) + middle + "".join(after)
    if r.random() < 0.2:
        body = f"<div id=wrapper>{body}</div>"
    return f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"


@functools.cache
def trained(pages: int = 500, rounds: int = 220, seed: int = 11) -> Tree:
    """Fits the model on composed pages. A bounded job of seconds, done once where the query is built."""
    r = random.Random(seed)
    parsed = [Page(compose(r)) for _ in range(pages)]
    blocks = [p.blocks() for p in parsed]
    x, parent, depth, kind = features(parsed, [[(n, t.replace(_MARK, "")) for n, t in b] for b in blocks])
    first = np.cumsum([0] + [len(p.parent) for p in parsed])
    y = np.full(len(x), -1)
    for b, f in zip(blocks, first, strict=False):
        for node, text in b:
            y[f + node] = max(y[f + node], int(_MARK in text))
    # a block without text of its own is content if most of the text below it is
    own = np.array([1.0] * len(x)) * (y >= 0)
    good = np.where(y == 1, own, 0.0)
    size, share = own.copy(), good.copy()
    for at in levels(depth)[:0:-1]:
        np.add.at(size, parent[at], size[at])
        np.add.at(share, parent[at], share[at])
    y = np.where(y >= 0, y, (share > 0.5 * np.maximum(size, 1)).astype(int))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    w, pair = np.zeros(x.shape[1]), np.zeros((len(KINDS), 2, 2))
    mw, vw, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)
    for t in range(1, rounds + 1):
        p, edge, _ = marginals(x @ w, pair, parent, depth, kind)
        gw = (x.T @ (y - p[:, 1]) - 0.3 * w) / pages
        expected = np.zeros_like(pair)
        np.add.at(expected, kind[child], edge[child])
        gp = (seen - expected - 0.3 * pair) / pages
        for v, g, m, s in ((w, gw, mw, vw), (pair, gp, mp, vp)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Tree(w, pair)


def extract(pages: DataFrame, model: Tree | None = None) -> DataFrame:
    """pages (any columns, html) -> the same without html, with text and n_chars; columns of these names give way to them."""
    model = model or trained()

    made = [StructField("text", StringType()), StructField("n_chars", LongType())]
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]

    def of(batches):
        for batch in batches:
            html_, out = batch.column(len(kept)), []
            for s in range(0, len(batch), 64):
                out += model.texts([h or "" for h in html_.slice(s, 64).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[f.name for f in [*kept, *made]])

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col("html").cast("string")).mapInArrow(of, StructType([*kept, *made]))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
