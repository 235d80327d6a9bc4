"""Main text of web pages: boosted trees score DOM nodes, a tree dynamic programme decodes them.

A page is parsed in linear time into its block nodes (text of inline elements counts to the block around them). The trees see
the node's tag, what the words of its class, id and role weigh (the log odds of each word, learnt with the trees; unknown words
weigh nothing), also those around it, its depth, place among its siblings and in the page, and the text, link, sentence and
tag density of its subtree, also of its parent. They are trained on pages that pages_to_learn() invents, whose
boilerplate is known; no table is needed. Decoding takes the labelling of greatest total score in which nothing inside a
dropped node is kept.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a newline.
Null and empty html give the empty text, as do pages without any text. Null page_ids and urls are passed on. Repeated rows
are extracted alike. Extra columns are ignored. Unclosed or stray tags, comments and quotes never fail; a page without
tags is one block.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Trees

_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea".split()}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*+>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture source input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
LISTS = ["ul", "ol", "dl", "table", "menu"]
BAD = -2.0
TAGS = ("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "nav", "header", "footer", "aside", "form button select fieldset option", "article", "main", "section", "div", "table tr td th tbody thead", "figure figcaption", "blockquote pre", "head title")
_TAG = {t: i for i, g in enumerate(TAGS) for t in g.split()}


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "inside", "links", "chars", "kids", "ends", "first", "order", "tags", "total", "linked", "stops", "blocks", "own", "near")

    def __init__(self, tag: str, parent: int, depth: int, words: list[str], inside: int, first: int, order: int):
        self.tag, self.parent, self.depth, self.words, self.inside, self.first, self.order = tag, parent, depth, words, inside, first, order
        self.kids = self.links = self.chars = self.ends = self.tags = 0


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag name, closes, attributes) of each tag of a page; the last has no name. Comments, declarations and
    elements whose content is no text are left out. Each character is looked at a bounded number of times: where nothing
    closes a tag any more the rest is text, and once a tag's quotes never close, quotes do not count in the rest of the page."""
    at, text, last, quotes = 0, [], page.rfind(">"), True
    while (lt := page.find("<", at)) >= 0:
        text.append(page[at:lt])
        at = lt + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = len(page) if end < 0 else end + 3
            continue
        if lt > last:
            text.append("<")
            continue
        if page[at : at + 1] in ("!", "?"):
            at = page.find(">", at) + 1
            continue
        m = _NAME.match(page, at)
        if not m:
            text.append("<")
            continue
        end = _QUOTED.match(page, m.end()) if quotes else None
        quotes = end is not None
        end = end.end() if end else page.find(">", m.end()) + 1
        name, shut = m[1].lower(), page[at] == "/"
        at = end
        if name in _RAW and not shut:
            close = _RAW[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        yield "".join(text), name, shut, page[m.end() : end - 1]
        text.clear()
    text.append(page[at:])
    yield "".join(text), "", False, ""


def parse(page: str, weights: dict[str, float] | None = None) -> tuple[list[Node], list[tuple[int, str | None]], int]:
    """Block nodes in page order (node 0 is the root), the text pieces with their node, and the length of all text.

    A piece of None, in place of a string, marks the edge of a block. Inline elements are nodes only where an attribute word
    of theirs weighs under BAD."""
    weights = weights or {}
    nodes = [Node("root", -1, 0, [], 0, 0, 0)]
    pieces: list[tuple[int, str | None]] = []
    stack: list[tuple[str, int]] = [("root", 0)]
    opened: dict[str, list[int]] = {}  # places on the stack by name
    outer = [0]  # places of elements that are not inline
    chars = in_link = 0
    inner = lambda names: max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def pop(to: int) -> None:
        nonlocal in_link
        while len(stack) > to:
            t, k = stack.pop()
            opened[t].pop()
            if outer[-1] == len(stack):
                outer.pop()
            if t == "a":
                in_link = 0
            if k != stack[-1][1]:
                pieces.append((stack[-1][1], None) if t not in INLINE else (stack[-1][1], ""))

    for s, name, shut, rest in tokens(page):
        if s:
            k = stack[-1][1]
            pieces.append((k, s))
            n = len(s) - s.count(" ")
            if n:
                x = nodes[k]
                x.chars += n
                x.links += n if in_link else 0
                x.ends += s.count(". ") + s.count(".") + s.count("!") + s.count("?")
                chars += n
        if not name:
            break
        if shut:
            if opened.get(name):
                pop(opened[name][-1])
            continue
        if name in CLOSES_P:
            if stack[outer[-1]][0] == "p":
                pop(outer[-1])
        elif name in SAME and (to := inner(SAME[name])) > inner(LISTS):
            pop(to)
        up = stack[-1][1]
        nodes[up].tags += 1
        words: list[str] = []
        for a in _ATTR.finditer(rest) if "=" in rest else ():
            words += _WORD.findall((a[2] or a[3] or a[4] or "").lower())
        if name in VOID:
            pieces.append((up, " " if name in INLINE else None))
            continue
        if name == "a":
            in_link = 1
        opened.setdefault(name, []).append(len(stack))
        if name in INLINE and not any(weights.get(w, 0) < BAD for w in words):
            stack.append((name, up))
            continue
        if name not in INLINE:
            outer.append(len(stack))
        p = nodes[up]
        pieces.append((up, None if name not in INLINE else ""))
        p.kids += 1
        inside = p.inside | 1 << _TAG[p.tag] if p.tag in _TAG else p.inside
        nodes.append(Node(name, up, p.depth + 1, words, inside, chars, p.kids))
        stack.append((name, len(nodes) - 1))
    return nodes, pieces, chars


def weigh(pages: list[list[Node]], labels: list[list[bool]]) -> dict[str, float]:
    """The log odds of kept for each attribute word of the pages to learn from."""
    n: dict[str, list[int]] = {}
    for nodes, label in zip(pages, labels):
        for x, y in zip(nodes, label):
            for w in set(x.words):
                n.setdefault(w, [0, 0])[y] += 1
    return {w: math.log((k + 1) / (d + 1)) for w, (d, k) in n.items()}


def features(nodes: list[Node], chars: int, weights: dict[str, float]) -> np.ndarray:
    for x in nodes:
        x.total, x.linked, x.stops, x.blocks = x.chars, x.links, x.ends, 1
        v = [weights.get(w, 0.0) for w in x.words]
        x.own = (min(v, default=0.0), max(v, default=0.0))
        a = nodes[x.parent].near if x.parent >= 0 else (0.0, 0.0)
        x.near = (min(a[0], x.own[0]), max(a[1], x.own[1]))
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        p = nodes[x.parent]
        p.total += x.total
        p.linked += x.linked
        p.stops += x.stops
        p.tags += x.tags
        p.blocks += x.blocks
    rows = []
    for x in nodes:
        p = nodes[max(0, x.parent)]
        t, u = _TAG.get(x.tag, -1), _TAG.get(p.tag, -1)
        row = [t == i for i in range(len(TAGS))]
        row += [x.inside >> i & 1 for i in range(len(TAGS))] + [u == i for i in range(len(TAGS))]
        row += [
            *x.own, *p.own, *p.near, x.depth, x.kids, x.order, p.kids, x.order / max(1, p.kids), x.first / max(1, chars), x.total / max(1, chars), x.total, x.chars, x.linked / max(1, x.total),
            x.stops / max(1, x.total), x.total / x.blocks, x.tags / max(1, x.total), x.blocks, p.linked / max(1, p.total), p.total / max(1, chars), p.total / p.blocks,
        ]
        rows.append(row)
    return np.array(rows, np.float32)


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The labels of greatest total score (kept: score, dropped: -score) with no node kept inside a dropped one."""
    n = len(nodes)
    keep, gone = score.astype(float).copy(), -score.astype(float)
    take = np.ones(n, bool)
    for i in range(n - 1, 0, -1):
        take[i] = keep[i] >= gone[i]
        p = nodes[i].parent
        keep[p] += max(keep[i], gone[i])
        gone[p] += gone[i]
    for i in range(1, n):
        take[i] &= take[nodes[i].parent]
    return take


def text_of(pieces: list[tuple[int, str | None]], take: np.ndarray) -> str:
    blocks, now = [], []
    for k, s in [*pieces, (0, None)]:
        if s is None:
            if now:
                if block := " ".join(html.unescape("".join(now)).split()):
                    blocks.append(block)
                now = []
        elif take[k]:
            now.append(s)
    return "\n".join(blocks)


#: What the classes and ids of the invented pages are called, by the part of the page; the trees see only what their words weigh.
GROUPS = (
    "article main content post entry story body text page",
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc",
    "ad ads advert adverts advertisement sponsor sponsored promo banner",
    "cookie cookies consent notice alert gdpr popup modal overlay message",
    "comment comments discussion disqus reply replies respond thread",
    "share social follow subscribe newsletter signup login search form",
    "header masthead topbar logo site branding",
    "footer copyright legal colophon bottom",
    "sidebar side aside rail widget related recommended more popular",
)


def pages_to_learn(n: int, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Invented pages with the label of each block node, in page order."""
    r = random.Random(seed)

    def words(a: int, b: int, stop: bool = True) -> str:
        often = r.choice([0, 0.02, 0.1, 0.3])
        out = ["x" * r.randint(2, 12) + (r.choice(".,!?") if r.random() < often else "") for _ in range(r.randint(a, b))]
        return " ".join(out) + ("." if r.random() < (0.8 if stop else 0.25) else "")

    def page() -> tuple[str, list[bool]]:
        out, labels = [], [True]

        def tag(name: str, attr: str, keep: bool, inside, close: bool = True) -> None:
            out.append(f"<{name}{' ' + attr if attr else ''}>")
            labels.append(keep)
            inside() if callable(inside) else out.append(inside)
            if close:
                out.append(f"</{name}>")

        def name() -> str:
            """A name that says nothing."""
            return "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 7)))

        def attr(*groups: int) -> str:
            if r.random() < 0.25:
                return ""
            w = r.choice(GROUPS[r.choice(groups)].split()) if r.random() < 0.7 else name()
            return r.choice([f'class="{w}"', f'id="{w}"', f'class="{w} box"', f'class="{w}-block"', f'role="{w}"'])

        def links(keep: bool, k: int) -> None:
            tag("ul", "", keep, lambda: [tag("li", "", keep, f'<a href="/x">{words(1, 4, False)}</a>') for _ in range(k)])

        def nav(inner: bool = False) -> None:
            t = r.choice(["nav", "div", "ul", "nav"])
            a = attr(1) if t == "nav" or r.random() < 0.3 else f'class="{r.choice(GROUPS[1].split())}"'
            tag(t, a, False, lambda: links(False, r.randint(2, 9)) if t != "ul" else [tag("li", "", False, f'<a href="/">{words(1, 3, False)}</a>') for _ in range(r.randint(2, 8))])

        def ad() -> None:
            a = r.choice([2, 2, 3, 5])
            tag(r.choice(["div", "aside", "section", "p"]), f'{r.choice(["class", "id"])}="{r.choice(GROUPS[a].split())}"', False, words(3, 60))

        def notice() -> None:
            w = r.choice(GROUPS[3].split())
            tag("div", f'{r.choice(["class", "id", "role"])}="{w}"', False, lambda: tag("p", "", False, words(5, 50)) if r.random() < 0.6 else out.append(words(5, 50)))

        def form() -> None:
            tag("form", attr(5), False, lambda: [tag(r.choice(["fieldset", "p", "div"]), "", False, f"<label>{words(1, 4, False)}</label><input name=q>") for _ in range(r.randint(1, 4))])

        def side() -> None:
            t = r.choice(["aside", "div"])
            tag(t, attr(8) if t == "aside" else f'class="{r.choice(GROUPS[8].split())}"', False, lambda: [r.choice([lambda: links(False, r.randint(2, 6)), lambda: tag("p", "", False, words(5, 60)), lambda: tag(r.choice(["h3", "h4"]), "", False, words(1, 5, False))])() for _ in range(r.randint(1, 5))])

        def comments() -> None:
            def one() -> None:
                tag(r.choice(["div", "li", "article"]), attr(4), False, lambda: [tag("p", "", False, words(3, 70)) for _ in range(r.randint(1, 3))])

            tag(r.choice(["section", "div", "ol"]), f'{r.choice(["class", "id"])}="{r.choice(GROUPS[4].split())}"', False, lambda: [tag("h3", "", False, words(1, 3, False)) if r.random() < 0.5 else None, *[one() for _ in range(r.randint(1, 7))]])

        def head() -> None:
            tag("header" if r.random() < 0.7 else "div", f'class="{r.choice(GROUPS[6].split())}"' if r.random() < 0.7 else "", False, lambda: r.choice([lambda: nav(True), lambda: tag("p", "", False, words(1, 12, False)), lambda: tag("h1", "", False, words(1, 4, False))])()) if r.random() < 0.75 else None

        def foot() -> None:
            t = r.choice(["footer", "footer", "div"])
            inside = r.choice([lambda: out.append("&copy; " + words(2, 25)), lambda: tag("p", "", False, words(3, 30)), lambda: links(False, 4)])
            tag(t, "" if t == "footer" and r.random() < 0.6 else f'class="{r.choice(GROUPS[7].split())}"', False, inside)

        def block() -> None:
            x = r.random()
            if x < 0.76:
                tag("p", "", True, ("<b>" if r.random() < 0.1 else "") + words(1, r.choice([4, 15, 60, 150])) + ("<br>" if r.random() < 0.1 else "") + (f' <a href="/y">{words(1, 5)}</a> {words(1, 20)}' if r.random() < 0.25 else ""), r.random() < 0.9)
            elif x < 0.84:
                tag(r.choice(["h2", "h3"]), "", True, words(1, 9, False))
            elif x < 0.9:
                tag(r.choice(["ul", "ol"]), "", True, lambda: [tag("li", "", True, words(2, 30)) for _ in range(r.randint(2, 6))])
            elif x < 0.94:
                tag("blockquote", "", True, lambda: tag("p", "", True, words(5, 50)))
            elif x < 0.96:
                tag("pre", "", True, words(5, 40))
            elif x < 0.98:
                tag("table", "", True, lambda: [tag("tr", "", True, lambda: [tag("td", "", True, words(1, 5, False)) for _ in range(3)]) for _ in range(r.randint(1, 4))])
            else:
                tag("div", "", True, words(10, 80))

        def body() -> None:
            title = lambda: tag("h1", "", True, words(1, 14, False))
            if r.random() < 0.9:
                title() if r.random() < 0.85 else tag("header", "", True, title)
            for _ in range(r.choice([0, 1, 1, 2, 2, 3, 5, 8, 12, 20])):
                block()
                if r.random() < 0.06:
                    r.choice([ad, form, side, notice])()

        def main() -> None:
            t = r.choice(["article", "article", "main", "div", "section"])
            a = attr(0) if t in ("article", "main") or r.random() < 0.3 else f'{r.choice(["class", "id"])}="{r.choice(GROUPS[0].split())}"' if r.random() < 0.75 else ""
            tag(t, a, True, body if r.random() < 0.8 else lambda: tag(r.choice(["div", "section"]), attr(0), True, body))

        def all_() -> None:
            top = [nav, ad, notice, head, head]
            for f in r.sample(top, r.randint(0, 4)):
                f()
            if r.random() < 0.2:
                side()
            main()
            for f in [x for x in (side, ad, comments, form, nav, notice) if r.random() < 0.3]:
                f()
            if r.random() < 0.85:
                foot()

        tag("html", "", True, lambda: (tag("head", "", False, lambda: tag("title", "", False, words(1, 9, False))), tag("body", "", True, all_ if r.random() < 0.7 else lambda: tag("div", r.choice(["", 'id="page"', 'class="wrapper"']), True, all_))))
        return "".join(out), labels

    return [page() for _ in range(n)]


class Model(NamedTuple):
    """The weights of attribute words and the trees."""

    weights: dict[str, float]
    trees: Trees

    def score(self, page: tuple) -> np.ndarray:
        return self.trees.score(features(page[0], page[2], self.weights))


_model: dict = {}


def model(pages: int = 900, seed: int = 7) -> Model:
    """Learnt from invented pages; the same on every run."""
    if (pages, seed) not in _model:
        got = [(parse(page), labels) for page, labels in pages_to_learn(pages, seed)]
        got = [(p, y) for p, y in got if len(p[0]) == len(y)]
        weights = weigh([p[0] for p, _ in got], [y for _, y in got])
        x = np.concatenate([features(p[0], p[2], weights) for p, _ in got])
        _model[pages, seed] = Model(weights, Trees(rounds=60, depth=4).fit(x, np.concatenate([np.array(y, float) for _, y in got])))
    return _model[pages, seed]


def main_texts(pages: list[str | None], m: Model) -> list[str]:
    parsed = [parse(p or "", m.weights) for p in pages]
    if not parsed:
        return []
    score = m.trees.score(np.concatenate([features(n, c, m.weights) for n, _, c in parsed]))
    out, at = [], 0
    for nodes, pieces, _ in parsed:
        out.append(text_of(pieces, decode(nodes, score[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, m: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    m = m or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(part.column(2).to_pylist(), m), pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
