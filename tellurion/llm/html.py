"""Operator 7: main text of web pages by gradient-boosted trees over DOM nodes.

Each block-level node gets features of itself, its subtree (text, link and tag density), its attribute tokens, its depth
and its siblings; boosted trees give the chance that the node's subtree holds main text. Hierarchical decoding then
picks the most likely labelling of the whole tree in which nothing below a dropped node is kept. No labelled pages exist, so
the trees are fitted on pages that `synthetic_pages` composes, with their main parts known.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas button label".split())
_HEAD = frozenset("html head body title noscript template object frameset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_NEVER = frozenset("head script style title noscript template iframe canvas select option textarea button nav menu dialog audio video".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Groups of attribute tokens (of class, id and role); a token counts for a group if it begins with one of its words.
_TOKENS = {
    "menu": "nav menu breadcrumb topbar toolbar tabs pagination pager crumb sitenav",
    "edge": "header footer masthead banner colophon copyright legal foot head site-header site-footer page-header page-footer",
    "side": "sidebar aside side widget rail related recommend more-from popular trending complementary see-also",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp teaser-ad outbrain taboola",
    "talk": "comment comments disqus discussion reply replies respond responses thread feedback reviews",
    "notice": "cookie consent gdpr notice alert modal popup overlay subscribe newsletter signup login paywall toast disclaimer",
    "share": "share sharing social tags tag-list author-bio byline-links meta-links print follow",
    "main": "article main content post entry story body text prose blog hentry page-content post-content entry-content article-body",
}
_GROUP = {w: k for k, words in enumerate(_TOKENS.values()) for w in words.split()}
_TAGS = ("body", "article", "main", "section", "div", "p", "ul", "ol", "li", "table", "td", "h1", "h2", "h3", "header", "footer", "nav", "aside", "blockquote", "pre", "figure", "form")
_OWN = len(_TAGS) + len(_TOKENS) + 13
FEATURES = _OWN + 3 * len(_TOKENS) + 6


@dataclass(eq=False)
class Node:
    tag: str
    groups: frozenset[int]
    parent: Node | None
    depth: int
    order: int
    items: list = field(default_factory=list)  # child nodes and texts, in page order

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", frozenset(), None, 0, 0)
        self.nodes, self.open, self.text, self.links, self.raw = [self.root], [self.root], [], 0, 0
        self.held: Counter[str] = Counter()  # open nodes by tag
        self.drawing = 0  # open svg elements, which are neither text nor a break in it

    def _flush(self) -> None:
        if self.text:
            own = " ".join("".join(t for t, _ in self.text).split())
            if own:
                self.open[-1].items.append((own, sum(len(t.strip()) for t, link in self.text if link)))
            self.text = []

    def _pop(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        if not any(self.held[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._flush()
                self._close(k)
                return
            if self.open[k].tag in until:
                return

    def _close(self, k: int) -> None:
        for node in self.open[k:]:
            self.held[node.tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _RAW:
            self.raw += 1
            return
        if tag == "svg":
            self.drawing += 1
        if self.drawing:
            if tag not in _BLOCKS or tag == "title":
                return
            self.drawing = 0  # a block ends a drawing that was left open
        if tag == "a":
            self.links += 1
        if tag in ("br", "img", "wbr"):
            self.text.append(("" if tag == "wbr" else " ", False))
        if tag not in _BLOCKS:
            return
        if tag not in _HEAD and not self.held["body"]:  # the body's own tag may be left out
            self._pop(("head",), ())
            self.handle_starttag("body", [])
        if tag in _CLOSES_P:
            self._pop(("p",), ("td", "th", "button"))
        if tag in _SAME:
            own, until = _SAME[tag]
            self._pop(tuple(own.split()), until)
        self._flush()
        if tag in ("html", "hr") or (tag == "body" and self.held["body"]):
            return
        if tag == "body":
            self._close(1)
        groups, hidden = set(), False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for token in re.split(r"[\s,]+", value.lower()):
                    for part in (token, *re.split(r"[-_]+", token)):
                        if part in _GROUP:
                            groups.add(_GROUP[part])
            hidden |= name == "hidden" or (name == "style" and bool(value) and "display:none" in value.replace(" ", "").lower())
        node = Node("template" if hidden else tag, frozenset(groups), self.open[-1], len(self.open), len(self.nodes))
        self.open[-1].items.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.held[node.tag] += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag == "svg":
            return
        self.handle_starttag(tag, attrs)
        if tag in _BLOCKS and tag not in _VOID and not self.drawing:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _RAW:
            self.raw = max(0, self.raw - 1)
        elif tag == "svg":
            self.drawing = max(0, self.drawing - 1)
        elif self.drawing and tag == "title":
            pass
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in _BLOCKS and tag != "html":
            if self.held[tag] or self.held["template"]:
                self._pop((tag, "template"), ())
            else:
                self._flush()

    def handle_data(self, data: str) -> None:
        if not self.raw and not self.drawing:
            self.text.append((data, self.links > 0))


def parse(html: str | None) -> list[Node]:
    """The page's block nodes in page order, the root first."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder._flush()
    return builder.nodes


def features(nodes: list[Node]) -> np.ndarray:
    """(nodes, FEATURES)."""
    n = len(nodes)
    x = np.zeros((n, FEATURES), np.float32)
    chars, links, own_chars, tags, stops, paragraphs, legal = (np.zeros(n) for _ in range(7))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        for item in node.items:
            if isinstance(item, Node):
                j = item.order
                chars[i] += chars[j]
                links[i] += links[j]
                tags[i] += tags[j] + 1
                stops[i] += stops[j]
                legal[i] += legal[j]
                paragraphs[i] += paragraphs[j] + (item.tag == "p")
            else:
                chars[i] += len(item[0])
                own_chars[i] += len(item[0])
                links[i] += min(item[1], len(item[0]))
                stops[i] += item[0].count(".") + item[0].count(",")
                legal[i] += "\xa9" in item[0] or item[0][:9].lower() == "copyright"
    total, k = max(1.0, chars[0]), len(_TAGS)
    place, count, weight = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n)  # among the siblings
    weight[0] = chars[0]
    for node in nodes:
        own = [c.order for c in node.children()]
        place[own] = np.arange(len(own))
        count[own], weight[own] = len(own), chars[own].sum()
    for i, node in enumerate(nodes):
        row = x[i]
        if node.tag in _TAGS:
            row[_TAGS.index(node.tag)] = 1
        for g in node.groups:
            row[k + g] = 1
        up, kin = node.parent, count[i]
        row[k + 8 : k + 21] = (
            node.depth / 10, np.log1p(chars[i]), links[i] / max(1.0, chars[i]), tags[i] * 20 / max(20.0, chars[i]), own_chars[i] / max(1.0, chars[i]), chars[i] / total,
            paragraphs[i] / 10, stops[i] * 20 / max(20.0, chars[i]), place[i] / kin, min(kin, 20) / 20, weight[i] / total, node.tag in _NEVER, legal[i] * 200 / max(200.0, chars[i]),
        )
        if up:
            for g in up.groups:
                row[_OWN + g] = 1
            # What the nodes above say is handed down.
            row[_OWN + 8 : _OWN + 16] = np.maximum(x[up.order, _OWN + 8 : _OWN + 16], x[up.order, k : k + 8])
            row[_OWN + 24 : _OWN + 28] = np.maximum(x[up.order, _OWN + 24 : _OWN + 28], (up.tag == "article" or up.tag == "main", up.tag == "footer" or up.tag == "header", up.tag == "aside", up.tag in _NEVER))
            row[_OWN + 28 :] = (links[up.order] / max(1.0, chars[up.order]), chars[up.order] / total)
        for c in node.children():
            for g in c.groups:
                row[_OWN + 16 + g] = 1
    return x


class Trees:
    """Gradient boosting of the logistic loss with histogram splits."""

    def __init__(self, rounds: int = 70, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z, flat = np.full(len(y), self.base), binned + np.arange(x.shape[1]) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            tree = []
            size = 2**self.depth
            feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
            for level in range(self.depth):
                for node in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(at == node - 2**level)
                    if len(rows) < 20:
                        continue
                    cells = flat[rows].ravel()
                    gs = np.bincount(cells, np.repeat(g[rows], x.shape[1]), x.shape[1] * self.bins).reshape(-1, self.bins).cumsum(1)
                    hs = np.bincount(cells, np.repeat(h[rows], x.shape[1]), x.shape[1] * self.bins).reshape(-1, self.bins).cumsum(1)
                    gain = gs**2 / (hs + self.l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.l2)
                    gain[(hs < 1e-3) | (hs[:, -1:] - hs < 1e-3)] = 0
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        feature[node], cut[node] = f, cuts[f][b]
                inner = at + 2**level
                at = at * 2 + (x[np.arange(len(y)), feature[inner]] > cut[inner])
            leaf = self.rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + self.l2)
            z += leaf[at]
            tree = (feature, cut, leaf)
            self.trees.append(tree)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = at * 2 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - 2**self.depth]
        return z


def _words(rng: random.Random, n: int) -> str:
    """Invented words, in sentences or, at times, in capitals, as a list or with marks."""
    own = ["".join(rng.choice("bdfgklmnprstvéüñ") + rng.choice("aeiouy") for _ in range(rng.randint(1, 4))) for _ in range(n)]
    style = rng.random()
    if style < 0.6:
        own = [w + rng.choice(("", "", "", "", "", "", ",", ".")) for w in own]
    elif style < 0.7:
        return " | ".join(own) + rng.choice(("", " |", "."))
    elif style < 0.8:
        return " ".join(w + rng.choice(("###", "$$$", "&amp;&amp;", "!!", "%%")) for w in own)
    elif style < 0.85:
        return " ".join(own).upper()
    return (" ".join(own)).capitalize() + rng.choice(("", ".", ".", "..."))


def synthetic_pages(count: int, seed: int = 11) -> list[str]:
    """Pages whose main parts lie between <!--M--> and <!--/M--> comments."""
    rng, out = random.Random(seed), []

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, rng.randint(1, 3))}</a></li>' for k in range(n)) + "</ul>"

    def name(*options: str) -> str:
        return rng.choice(options)

    def made_up() -> str:
        return "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiouy0123456789") for _ in range(rng.randint(2, 4)))

    def plain(text: str, tag: str = "div") -> str:
        """A box whose attributes say nothing."""
        return f'<{tag} {name("class", "id")}="{made_up()}{name("", " " + made_up())}">{text}</{tag}>'

    def box(group: str, text: str, tag: str = "div") -> str:
        words = _TOKENS[group].split()
        if rng.random() < (0.5 if group == "main" else 0.4 if group == "menu" else 0.05):
            return plain(text, tag)
        return f'<{tag} {name("class", "id")}="{name("", "box ", "c-")}{rng.choice(words)}{name("", " wide", "-inner", "_1")}">{text}</{tag}>'

    def prose(n: int) -> str:
        parts = []
        for _ in range(n):
            kind = rng.random()
            text = _words(rng, rng.choice((1, 1, 2, 3, 8, 25, 60, 120)))
            if kind < 0.75:
                parts.append(f"<p>{name('', '<b>', '<i>x</i> ')}{text}{name('', '<br>', ' <a href=x>' + _words(rng, 2) + '</a>')}{name('</p>', '</p>', '')}")
            elif kind < 0.85:
                parts.append("<h{0}>{1}</h{0}>".format(rng.randint(2, 4), _words(rng, 4)))
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<ul>" + "".join(f"<li>{_words(rng, rng.randint(3, 15))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            else:
                parts.append(f"<pre>{text}</pre><table><tr><td>{_words(rng, 3)}</td><td>{_words(rng, 5)}</td></tr></table>")
        return "".join(f"<!--M-->{p}<!--/M-->" for p in parts)

    for _ in range(count):
        inner = [f"<!--M--><h1>{_words(rng, rng.randint(2, 9))}</h1><!--/M-->", prose(rng.choice((0, 1, 1, 2, 3, 6, 12, 25, 25) if rng.random() < 0.98 else (200,)))]
        if rng.random() < 0.06:  # text that is broken into lines, without paragraphs
            inner[1] = "<!--M-->" + plain("<br><br>".join(_words(rng, rng.choice((8, 25, 60))) for _ in range(rng.randint(1, 5)))) + "<!--/M-->"
        style = rng.random()
        if style < 0.08:  # nothing but the text
            out.append(f"<html><head><title>{_words(rng, 4)}</title></head><body>{''.join(inner[rng.random() < 0.3 :])}</body></html>")
            continue
        for group in ("share", "ad", "side", "notice"):
            if rng.random() < 0.2:
                inner.append(box(group, rng.choice((links(rng.randint(2, 5)), f"<p>{_words(rng, rng.randint(4, 20))}</p>", _words(rng, rng.randint(3, 12)))), name("div", "section", "aside" if group == "side" else "div")))
        if rng.random() < 0.2:
            rng.shuffle(inner)
        talk = box("talk", f"<h3>{_words(rng, 1)}</h3>" + "".join(name("<div class='comment'>", "<li>", "<p>", "<article class='comment'>") + _words(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 4))), name("div", "section"))
        inside = rng.random() < 0.3
        body = "".join(inner) + (talk if inside else "")
        if rng.random() < 0.15:  # parts in boxes of their own
            body = name(plain(body), plain(plain(body)), f'<div class="row"><div class="col">{body}</div></div>')
        body = rng.choice((f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", box("main", body), box("main", body), f"<div><section>{body}</section></div>", f'<div role="main">{body}</div>', body, plain(body)))
        around = []
        if rng.random() < 0.8:
            around.append(name("<nav>" + links(rng.randint(3, 8)) + "</nav>", box("menu", links(rng.randint(3, 8))), "<header>" + links(4) + "</header>", f"<header><p>{_words(rng, 4)}</p></header>", box("edge", f"<p>{_words(rng, 5)}</p>")))
        for group in ("ad", "notice"):
            if rng.random() < 0.5:
                around.append(box(group, rng.choice((_words(rng, rng.randint(3, 25)), f"<p>{_words(rng, rng.randint(3, 25))}</p>")), name("div", "div", "section")))
        if rng.random() < 0.15:
            around.append(f"<form>{_words(rng, 5)}<input><button>{_words(rng, 1)}</button></form>")
        after = []
        if not inside and rng.random() < 0.3:
            after.append(talk)
        if rng.random() < 0.4:
            after.append(name(f"<aside><h3>{_words(rng, 2)}</h3>{links(4)}</aside>", f"<aside><p>{_words(rng, 20)}</p></aside>", box("side", links(5)), box("side", f"<p>{_words(rng, 25)}</p>")))
        if rng.random() < 0.9:
            after.append(name(f"<footer>{_words(rng, rng.randint(2, 40))}</footer>", f"<footer><p>{_words(rng, rng.randint(2, 40))}</p>{links(3)}</footer>", box("edge", f"<p>&copy; {_words(rng, 9)}</p>"), f"<footer>&copy; {_words(rng, 12)}", f"<p align='center'>&copy; {rng.randint(1995, 2025)} {_words(rng, rng.randint(2, 6))}</p>", f"<center>&copy; {_words(rng, 4)}</center>"))
        if rng.random() < 0.2:
            around, after = around + after[-1:], after[:-1]
        page = "".join(around) + body + "".join(after)
        if style < 0.16:  # columns of a table
            page = f"{around[0] if around else ''}<table width='100%'><tr><td>{links(rng.randint(4, 9))}</td><td>{body}</td></tr></table>{''.join(after)}"
        if rng.random() < 0.08:  # pages of some servers are one form
            page = f"<form method='post' action='/{made_up()}'><input type='hidden'>{page}</form>"
        if rng.random() < 0.3:
            page = f"<div class='{name('wrap', 'container', 'page', 'site')}'>{page}</div>"
        out.append(f"<html><head><title>{_words(rng, 4)}</title><style>p{{}}</style></head><body>{page}{name('</body></html>', '')}")
    return out


def _known(html: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a synthetic page, and which of them hold main text."""
    marked = html.replace("<!--M-->", "<search>").replace("<!--/M-->", "</search>")
    plain, good = parse(html), []
    nodes = parse(marked)
    inside = {n.order: n.tag == "search" for n in nodes}
    for n in nodes:
        if n.parent and inside[n.parent.order]:
            inside[n.order] = True
    holds = dict(inside)
    for n in reversed(nodes):
        if holds[n.order] and n.parent:
            holds[n.parent.order] = True
    good = [holds[n.order] for n in nodes if n.tag != "search"]
    if len(good) != len(plain):  # marks met unclosed tags
        return [], np.zeros(0, bool)
    return plain, np.array(good)


@functools.cache
def fitted(pages: int = 900, seed: int = 11) -> Trees:
    xs, ys = [], []
    for html in synthetic_pages(pages, seed):
        nodes, good = _known(html)
        if nodes:
            xs.append(features(nodes)[1:])
            ys.append(good[1:])
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """Kept nodes: the labelling with the largest sum of log-chances in which no kept node lies below a dropped one."""
    z = np.clip(logit, -30, 30)
    keep, drop = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
    for i, node in enumerate(nodes):
        if node.tag in _NEVER:
            keep[i] = -1e6
    best, dropped = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.order
        dropped[up] += dropped[i]
        best[up] += max(best[i], dropped[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent.order] and best[i] > dropped[i]
    return kept


def _texts(node: Node, kept: np.ndarray) -> list[str]:
    out, stack = [], [iter(node.items)]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
        elif isinstance(item, Node):
            if kept[item.order]:
                stack.append(iter(item.items))
        else:
            out.append(item[0])
    return out


def extract_all(pages: list[str | None], trees: Trees) -> list[str]:
    """Main texts of pages."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    logit = trees.logit(np.concatenate([features(p) for p in parsed]))
    out, at = [], 0
    for nodes in parsed:
        own = logit[at : at + len(nodes)].copy()
        at += len(nodes)
        for n in nodes:
            if n.tag == "body":
                own[n.order] = 30
        out.append("\n".join(_texts(nodes[0], decode(nodes, own))))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page id, url, text (blocks joined by a line feed, empty if none), n_chars.

    A null or empty page has the empty text. Unclosed and crossed tags are mended as browsers do for paragraphs and list items.
    Null and repeated ids are kept; other columns are not read. The trees go to executors as one small object.
    """
    trees = fitted()
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def kernel(batch: pa.RecordBatch) -> dict:
        found = extract_all(batch.column("html").to_pylist(), trees)
        return {"id": batch.column("id"), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    source = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return map_batches(source, kernel, "id long, url string, text string, n_chars long", schema, 64).withColumnsRenamed({"id": id_col, "url": url_col})
