"""Operator 2: main text of web pages by gradient-boosted trees over DOM nodes, decoded from the root down.

A tolerant scanner turns a page into block nodes (elements that start a new block, and the runs of text between them)
with the usual implied end tags. Each node gets numbers: its tag's kind, words of its class, id and role attributes,
depth, characters, tags and links of its subtree (density), its place among its siblings and their sizes, and what its
ancestors are called. Boosted regression trees give the log-odds that all of a node's text is main content. Decoding
chooses for every node to keep its subtree, to drop it or to leave the choice to its children, whichever has the
greatest likelihood, the children's weighed by their text; so no choice contradicts an ancestor's or a
descendant's.

The trees are trained here, on ``TRAIN_PAGES`` pages written by :func:`training_page` with known main text, since the
tables have no labelled pages; training is seeded and bounded, and happens once, on the driver.

Defined cases: null or empty pages give an empty text and 0 characters; a page cut off anywhere is read as far as it
goes, an unfinished tag at its end is dropped; repeated rows give equal results; a null id or url is returned as it is.
Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TRAIN_PAGES = 1200
TREES, DEPTH, BINS, RATE = 50, 4, 32, 0.3

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot "
    "th thead title tr ul button textarea iframe svg object video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg noframes xmp".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style textarea title noscript iframe template svg noframes head select option button object video audio canvas".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
KINDS = ["article main", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "nav", "aside", "header hgroup", "footer", "form fieldset legend", "div section center", "blockquote pre figure figcaption", "table tbody thead tr td th", "body html", "#text"]
KIND = {t: i for i, tags in enumerate(KINDS) for t in tags.split()}
#: Words of class, id and role attributes.
NAMES = [
    "article content post entry story main text body copy prose",
    "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager",
    "header masthead banner topbar logo branding",
    "footer bottom copyright legal colophon contentinfo",
    "sidebar side aside rail widget related recommended trending popular more complementary",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense",
    "cookie cookies consent gdpr notice alert banner popup modal overlay subscribe newsletter signup paywall",
    "comment comments reply replies respond discussion disqus feedback reader",
    "share social follow tweet login search form tags meta byline author",
]
NAME: dict[str, list[int]] = {}
for _i, _words in enumerate(NAMES):
    for _w in _words.split():
        NAME.setdefault(_w, []).append(_i)

#: White space, slashes and attributes of a tag. A quote opens a string only as the first character of a value, and only if it is closed.
_ATTRS = r"""(?>[ \t\n\f\r/]+|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*"|'[^']*'|[^ \t\n\f\r>]*+))?)*+"""
#: A comment (``<!-->`` and ``<!--->`` end at once), a tag, or a declaration or what HTML reads as a comment.
SCAN = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)(""" + _ATTRS + r""")(>|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)""", re.S)
#: An unquoted value at the end of a tag: a slash there belongs to the value.
VALUE_LAST = re.compile(r"""=[ \t\n\f\r]*[^ \t\n\f\r>"'][^ \t\n\f\r>]*\Z""")
HREF = re.compile(r"(?:^|[\s/\"'])href\s*=", re.I)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in document order: tag, parent, attribute words, own text segments, characters in links, tags inside."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.names, self.text, self.linked, self.inner = [], [], [], [], [], []
        self._scan(source or "")

    def _node(self, tag: str, parent: int, names: frozenset = frozenset()) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.text.append([])
        self.linked.append(0)
        self.inner.append(0)
        return len(self.tag) - 1

    def _scan(self, s: str) -> None:
        """One pass. The open elements are a stack; ``places`` has the places of each tag's open elements there and
        ``blocks`` those of block elements, so no tag costs more than the elements that it closes."""
        root = self._node("html", -1)
        stack: list[tuple[str, int, bool]] = [("html", root, False)]  # tag, block node that text goes to, whether a link
        places: dict[str, list[int]] = {}
        blocks: list[int] = []
        leaf, links, at = -1, 0, 0

        def say(piece: str) -> None:
            nonlocal leaf
            if leaf < 0:
                if not piece.strip():
                    return
                leaf = self._node("#text", stack[-1][1])
            self.text[leaf].append(piece)
            if links:
                self.linked[leaf] += len(piece)

        def opened(tag: str, node: int, link: bool) -> None:
            nonlocal links
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append((tag, node, link))
            links += link

        def closed(place: int) -> bool:
            """Close all from ``place`` on; whether a block was among them."""
            nonlocal links
            block = bool(blocks) and blocks[-1] >= place
            while len(stack) > place:
                tag, _, link = stack.pop()
                places[tag].pop()
                links -= link
            while blocks and blocks[-1] >= place:
                blocks.pop()
            return block

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def implied(tag: str) -> None:
            """Close what a start tag closes: list items and cells by their like, a paragraph by any block."""
            if tag in CLOSES:
                like = last(CLOSES[tag][0].split())
                if like and like > last(CLOSES[tag][1]):
                    closed(like)
                    return
            if blocks:
                top = stack[blocks[-1]][0]
                if top == "p" or top == "head" and tag not in HIDDEN:
                    closed(blocks[-1])

        end, find = len(s), SCAN.search
        while at < end:
            m = find(s, at)
            if not m:
                say(s[at:])
                break
            if m.start() > at:
                say(s[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if not m[4]:  # cut off inside a tag
                break
            if m[1]:
                place = last((tag,))
                # an inline end tag does not close a block
                if place and (tag in BLOCKS or not blocks or blocks[-1] < place) and closed(place):
                    leaf = -1
                continue
            # only void elements and drawings end by a slash
            alone = tag in VOID or tag == "svg" and m[3].endswith("/") and not VALUE_LAST.search(m[3])
            if tag in BLOCKS:
                leaf = -1
                implied(tag)
                names = frozenset()
                if len(m[3]) > 4:
                    found = " ".join(x or y or z for _, x, y, z in ATTR.findall(m[3]))
                    if found:
                        names = frozenset(i for w in PART.findall(found) for i in NAME.get(w.lower(), ()))
                if tag == "html" or tag == "body" and places.get("body"):
                    continue
                node = self._node(tag, stack[-1][1], names)
                if not alone:
                    opened(tag, node, False)
            else:
                if leaf >= 0:
                    self.inner[leaf] += 1
                if tag == "br":
                    if leaf >= 0:
                        self.text[leaf].append(" ")
                elif not alone and tag not in RAW:
                    opened(tag, stack[-1][1], tag == "a" and bool(HREF.search(m[3])))
            if tag in RAW and not alone:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(s, at)
                at = close.start() if close else end
                if tag not in BLOCKS:
                    m = find(s, at)
                    at = m.end() if m else end

    def strings(self) -> list[str]:
        """The text of each node, decoded, each run of white space one space."""
        return [" ".join(entities.unescape("".join(t)).split()) if t else "" for t in self.text]


FEATURES = 2 * len(KINDS) + 2 * len(NAMES) + 18


def features(page: Page, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Node features, and the characters of each node's subtree."""
    n = len(page.tag)
    parent = np.array(page.parent)
    kind = np.array([KIND.get(t, -1) for t in page.tag])
    own = np.array([len(s) for s in strings], float)
    stat = np.zeros((n, 6))  # characters, linked characters, tags, text runs, words, sentences ended
    stat[:, 0] = own
    stat[:, 1] = np.minimum(page.linked, own)
    stat[:, 2] = 1 + np.array(page.inner)
    stat[:, 3] = own > 0
    stat[:, 4] = [s.count(" ") + 1 if s else 0 for s in strings]
    stat[:, 5] = [s[-1:] in ".!?…\"'" if s else 0 for s in strings]
    depth, index, kids = np.zeros(n), np.zeros(n), np.zeros(n)
    names, above = np.zeros((n, len(NAMES)), bool), np.zeros((n, len(NAMES)), bool)
    kinds_above = np.zeros((n, len(KINDS)), bool)
    hidden = np.zeros(n, bool)
    for i in range(1, n):  # parents come before their children
        p = parent[i]
        depth[i] = depth[p] + 1
        index[i] = kids[p]
        kids[p] += 1
        above[i] = above[p]
        kinds_above[i] = kinds_above[p]
        for k in page.names[p]:
            above[i, k] = 1
        if kind[p] >= 0:
            kinds_above[i, kind[p]] = 1
        for k in page.names[i]:
            names[i, k] = 1
        hidden[i] = hidden[p] or page.tag[i] in HIDDEN
    stat[hidden] = 0
    before = np.cumsum(stat[:, 0]) - stat[:, 0]
    for i in range(n - 1, 0, -1):
        stat[parent[i]] += stat[i]
    chars = stat[:, 0]
    largest, total_kids = np.zeros(n), kids[parent]
    np.maximum.at(largest, parent[1:], chars[1:])
    tagged = np.zeros((n, len(KINDS)), bool)
    ok = kind >= 0
    tagged[ok, kind[ok]] = 1
    size = np.maximum(chars, 1)
    up = np.maximum(parent, 0)
    rest = np.stack(
        [
            depth, np.log1p(chars), chars / stat[:, 2].clip(1), stat[:, 1] / size, stat[:, 3], stat[:, 4] / stat[:, 3].clip(1), stat[:, 5] / stat[:, 3].clip(1), kids,
            index, index / np.maximum(total_kids - 1, 1), total_kids, chars / np.maximum(largest[up], 1), chars / max(chars[0], 1), before / max(chars[0], 1),
            stat[up, 1] / np.maximum(chars[up], 1), np.log1p(chars[up]), stat[up, 3], chars / np.maximum(chars[up], 1),
        ],
        axis=1,
    )
    chars = np.where(hidden, 0, chars)
    return np.concatenate([tagged, kinds_above, names, above, rest], axis=1).astype(np.float32), chars


# --- boosted trees --------------------------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted regression trees for the logistic loss; features are cut at quantiles."""

    def __init__(self):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        self.base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree, leaf = self._grow(binned, g, h)
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Level by level; nodes are numbered as in a heap."""
        n, f = b.shape
        feature, cut = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, int)
        node = np.zeros(n, int)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = (1e-3, -1, 0)
                if len(rows) > 20:
                    gk, hk = g[rows], h[rows]
                    gs, hs = gk.sum(), hk.sum()
                    flat = (b[rows] + np.arange(f) * (BINS + 1)).ravel()
                    gb = np.bincount(flat, np.repeat(gk, f), f * (BINS + 1)).reshape(f, -1).cumsum(axis=1)[:, :-1]
                    hb = np.bincount(flat, np.repeat(hk, f), f * (BINS + 1)).reshape(f, -1).cumsum(axis=1)[:, :-1]
                    gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                    gain[(hb < 1) | (hs - hb < 1)] = 0
                    j, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[j, c] > best[0]:
                        best = (gain[j, c], j, c)
                feature[k], cut[k] = best[1], best[2]
                node[rows] = 2 * k + 1 + ((b[rows, best[1]] > best[2]) if best[1] >= 0 else 0)
        leaf = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        return (feature, cut, RATE * gs / (hs + 1)), leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        used = sorted({int(j) for feature, _, _ in self.trees for j in feature if j >= 0})
        place = {j: i for i, j in enumerate(used)}
        b = np.stack([np.searchsorted(self.cuts[j], x[:, j], side="left") for j in used], axis=1) if used else np.zeros((len(x), 1), int)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            col = np.array([place.get(int(j), 0) for j in feature])
            stop = feature < 0
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (~stop[node] & (b[rows, col[node]] > cut[node]))
            score += value[node - (2**DEPTH - 1)]
        return score


# --- training pages -------------------------------------------------------------------------------------------------


def training_page(r: random.Random) -> str:
    """A page whose words start with m where they are main content and with x elsewhere."""
    count = 0

    def words(lo: int, hi: int, main: bool) -> str:
        nonlocal count
        out = []
        for _ in range(r.randint(lo, hi)):
            count += 1
            out.append(("m" if main else "x") + "abcdefghij"[count % 10] * r.randint(1, 8))
        text = " ".join(out)
        return text.capitalize() + r.choice([".", ".", ".", "", "!"]) if r.random() < 0.9 else text

    def link(t: str) -> str:
        return f'<a href="/{r.randint(0, 99)}">{t}</a>'

    def attr(kinds: str, always: bool = False) -> str:
        if not always and r.random() < 0.3:
            return ""
        name = r.choice(kinds.split())
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} c{r.randint(1, 9)}"', f' class="site-{name}"', f" class='{name}-box'"])

    def para(main: bool) -> str:
        t = words(*r.choice([(1, 3), (3, 12), (10, 60), (20, 120)]), main)
        if r.random() < 0.2:
            t = f"<b>{t}" + r.choice(["</b>", "<br>", ""])
        if r.random() < 0.15:
            t += " " + link(words(1, 3, main))
        return f"<p>{t}" + r.choice(["</p>", "</p>", "\n"])

    def menu() -> str:
        items = "".join(f"<li>{link(words(1, 3, False))}</li>" for _ in range(r.randint(2, 9)))
        return r.choice([f"<nav{attr('nav menu navbar')}><ul>{items}</ul></nav>", f"<div{attr('menu nav navigation breadcrumb', True)}><ul>{items}</ul></div>", f"<nav>{items.replace('<li>', '').replace('</li>', ' ')}</nav>"])

    def ad() -> str:
        t = words(2, 30, False)
        return r.choice([f"<div{attr('ad ads advert promo sponsored', True)}>{t}</div>", f"<aside{attr('ad advert promo')}><p>{t}</p></aside>", f"<!-- ad {words(1, 3, False)} --><div{attr('ad advertisement', True)}><p>{t}</p><p>{words(1, 9, False)}</p></div>"])

    def side() -> str:
        items = "".join(f"<li>{link(words(2, 8, False))}</li>" for _ in range(r.randint(2, 7)))
        body = r.choice([f"<h3>{words(1, 3, False)}</h3><ul>{items}</ul>", f"<h2>{words(1, 3, False)}</h2><p>{words(5, 40, False)}</p>"])
        return r.choice([f"<aside{attr('sidebar widget related')}>{body}</aside>", f"<div{attr('sidebar rail related widget', True)}>{body}</div>"])

    def notice() -> str:
        t = words(5, 30, False)
        return f"<div{attr('cookie consent notice newsletter popup subscribe', True)}><p>{t}</p>" + r.choice(["", f"<button>{words(1, 2, False)}</button>"]) + "</div>"

    def form() -> str:
        return f"<form{attr('search login form signup')}><label>{words(1, 3, False)}</label><input name='q'><p>{words(1, 12, False)}</p><button>{words(1, 2, False)}</button></form>"

    def comments() -> str:
        one = lambda: r.choice(["<li{}><p>{}</p></li>", "<div{}><p>{}</p></div>", "<article{}><p>{}</p></article>"]).format(attr("comment reply", True), words(4, 60, False))
        body = f"<h3>{words(1, 2, False)}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
        return r.choice([f"<section{attr('comments discussion', True)}>{body}</section>", f"<div{attr('comments respond discussion', True)}>{body}</div>", f"<ol{attr('comments', True)}>{body}</ol>"])

    def junk() -> str:
        return r.choice([ad, ad, side, notice, form])()

    body = [f"<h1>{words(2, 12, True)}</h1>"]
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
        kind = r.random()
        if kind < 0.8:
            body.append(para(True))
        elif kind < 0.86:
            body.append(f"<h{r.randint(2, 4)}>{words(1, 8, True)}</h2>")
        elif kind < 0.92:
            body.append("<ul>" + "".join(f"<li>{words(2, 20, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.95:
            body.append(f"<blockquote>{r.choice([words(5, 40, True), para(True)])}</blockquote>")
        elif kind < 0.97:
            body.append("<table>" + "".join(f"<tr><td>{words(1, 4, True)}</td><td>{words(1, 4, True)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        else:
            body.append(junk())
    inner = "".join(body)
    if r.random() < 0.15:
        inner = f"<header>{menu()}</header>" + inner if r.random() < 0.3 else inner + comments()
    main = r.choice([f"<article{attr('post entry')}>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div{attr('content article post entry main story', True)}>{inner}</div>", f"<main><article>{inner}</article></main>", f"<section{attr('content article main')}>{inner}</section>", f"<div>{inner}</div>"])
    top = "".join(x() for x in (menu, ad, notice, form) if r.random() < 0.5)
    if r.random() < 0.4:
        top = f"<header{attr('header masthead')}>{top}<p>{words(1, 6, False)}</p></header>"
    foot = "".join(x() for x in (side, comments, ad, form, menu) if r.random() < 0.4)
    foot += r.choice([f"<footer{attr('footer')}>&copy; {words(1, 20, False)}</footer>", f"<div{attr('footer copyright', True)}><p>{words(2, 20, False)}</p>{menu()}</div>", ""])
    side_first = r.random() < 0.3
    page = f"<!DOCTYPE html><html><head><title>{words(1, 9, False)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{top}{side() if side_first else ''}{main}{foot}"
    return page + r.choice(["</body></html>", ""])


@lru_cache(maxsize=1)
def model() -> Boosted:
    """Trained on nodes whose text is all main or all not; what is mixed has no label."""
    r, xs, ys = random.Random(11), [], []
    for _ in range(TRAIN_PAGES):
        page = Page(training_page(r))
        strings = page.strings()
        x, chars = features(page, strings)
        main, other = np.zeros(len(x)), np.zeros(len(x))
        for i, s in enumerate(strings):
            for w in s.split():
                main[i] += w[0] in "mM"
                other[i] += w[0] in "xX"
        for i in range(len(x) - 1, 0, -1):
            main[page.parent[i]] += main[i]
            other[page.parent[i]] += other[i]
        pure = (chars > 0) & ((main == 0) | (other == 0))
        xs.append(x[pure])
        ys.append(main[pure] > 0)
        # a container with both kinds counts once for each, so that its odds stay near even and its children decide
        mixed = np.flatnonzero((main > 0) & (other > 0))
        xs += [x[mixed], x[mixed]]
        ys += [np.ones(len(mixed), bool), np.zeros(len(mixed), bool)]
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(parent: list[int], chars: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Nodes of kept subtrees. Bottom up, a node's best value is that of keeping it, dropping it, or the mean of its
    children's by their characters; top down, choices are read off."""
    n = len(parent)
    p = 1 / (1 + np.exp(-np.clip(odds, -15, 15)))
    keep, drop = np.log(p), np.log(1 - p)
    split, seen = np.zeros(n), np.zeros(n)
    best, choice = np.zeros(n), np.zeros(n, np.int8)
    for i in range(n - 1, -1, -1):
        value = split[i] / seen[i] if seen[i] else -np.inf
        best[i], choice[i] = max((keep[i], 1), (drop[i], 0), (value, 2))
        if i and chars[i] > 0:
            split[parent[i]] += best[i] * chars[i]
            seen[parent[i]] += chars[i]
    state = np.zeros(n, bool)
    for i in range(n):
        if i and choice[parent[i]] != 2:
            choice[i], state[i] = choice[parent[i]], state[parent[i]]
        else:
            state[i] = choice[i] == 1
    return state


def extract_all(sources, trees: Boosted | None = None) -> list[str]:
    """Main texts of pages; the trees run over the nodes of all of them at once."""
    pages, strings, xs, sizes = [], [], [], []
    for s in sources:
        page = Page(s)
        t = page.strings()
        x, chars = features(page, t)
        pages.append(page)
        strings.append(t)
        xs.append(x)
        sizes.append(chars)
    if not pages:
        return []
    odds = np.split((trees or model()).predict(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
    out = []
    for page, t, chars, o in zip(pages, strings, sizes, odds):
        kept = decode(page.parent, chars, o)
        out.append("\n".join(s for i, s in enumerate(t) if s and kept[i] and chars[i] > 0))
    return out


def extract(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. The trees are trained once, on the driver, and go with the tasks."""
    trees = model()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                text = extract_all(part[html_col], trees)
                yield pd.DataFrame({"page_id": part[id_col], "url": part[url_col], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(id_col, url_col, html_col).mapInPandas(texts, "page_id bigint, url string, text string, n_chars bigint")
