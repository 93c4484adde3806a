"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

A forgiving parser makes elements and text runs the nodes of a tree (void elements, implied ends of p, li and table parts, stray and missing end
tags; comments, scripts, styles and the like hold no text). Features: subtree text, link share, punctuation and density, attribute tokens of the node and
its ancestors, enclosing tags, depth, and sibling statistics. Boosted trees give each node the log-odds that it holds main text.
Decoding is hierarchical: a node without main text has no descendant with it, so of all labelings that obey this the most likely one is found by one
pass up (best score of each subtree with and without) and one pass down.

The trees are trained on the driver, once a session, on pages that generate() writes (menus, headers, notices, adverts, sidebars, forms,
comments, footers around articles, in several vocabularies of attributes); no input row is used. They are a few thousand numbers, broadcast.

Scale: one pass, no shuffle; work grows with the page's length.

Cases: null or empty html gives an empty text, as do pages without main text. Cut-off pages are parsed as far as they go. Repeated rows are handled
alike. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.llm._base import arrow

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "template", "noscript", "textarea", "iframe", "svg", "select")
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp script small span strong style sub sup template time tt u var wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BARRIER = frozenset("article aside blockquote body div dl footer form header html li main nav ol section table td th ul".split())
CLOSES_P = BARRIER - {"body", "html", "td", "th", "li"} | frozenset("h1 h2 h3 h4 h5 h6 p pre hr address figure fieldset".split())
#: Attribute tokens that tend to mark main text, and those that don't.
GOOD = frozenset("article articlebody body content entry main maincontent post story text".split())
BAD = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup privacy promo related search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
ENCLOSING = ("article", "main", "nav", "header", "footer", "aside", "form", "a", "head", "title", "li", "p", "table", "h1", "h2", "section", "button")

#: An attribute is a name, and after = a value in quotes or without; stray quotes are part of a name or of a value, as in browsers.
_NAME, _QUOTED = r"[^\s/>][^\s/>=]*+", r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_NAME}{_QUOTED})*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in (*SILENT, "title")}
_PUNCT = re.compile(r"[.,;:!?]")


_BAD_STEMS = tuple(sorted(t for t in BAD if len(t) > 5))


@lru_cache(100_000)
def _is_bad(token: str) -> bool:
    return token in BAD or token.startswith(_BAD_STEMS)


@lru_cache(100_000)
def _is_good(token: str) -> bool:
    return token in GOOD and not _is_bad(token)


class Page:
    """Nodes in document order: parent, end (of the subtree), features; texts of text nodes."""

    def __init__(self, source: str):
        self.parent, self.end, self.text, self.block = [-1], [0], [None], [True]
        self.numbers = [(0, 0, 0, 0, 0, 0, 0, 0, 0)]  # depth, characters, link characters, punctuation, p, sibling index, good, bad, own tokens
        self.inside = [(0,) * len(ENCLOSING)]
        self.children = [0]
        self.breaks: list[int] = []  # text nodes before which a new block or line begins
        self.stack, self.tags = [0], ["#root"]
        self.open_at: dict[str, list[int]] = defaultdict(list)  # by tag, the places on the stack where it is open: no end tag walks the stack
        self._new_block = True
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.match(source, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if source[m.start()] != "<" or m.end() - m.start() == 1:
                    self._put_text(m[0])
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3] or "")
                if tag in SILENT and not (tag == "svg" and (m[3] or "").rstrip().endswith("/")):
                    stop = _RAW[tag].search(source, at)
                    at = stop.end() if stop else n
                    self._pop()
        while len(self.stack) > 1:
            self._pop()
        self.end[0] = len(self.parent)

    def _node(self, parent: int, inside: tuple, numbers: tuple, text: str | None) -> int:
        self.parent.append(parent)
        self.end.append(len(self.parent))
        self.inside.append(inside)
        self.numbers.append(numbers)
        self.text.append(text)
        self.children.append(0)
        self.children[parent] += 1
        return len(self.parent) - 1

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag not in INLINE:
            self._new_block = True
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._implied({"p"}, BARRIER)
        if tag in ENDS and tag != "p":
            self._implied(ENDS[tag], {"table", "ul", "ol", "dl", "select"} if tag != "li" else {"ul", "ol"})
        parent = self.stack[-1]
        up = self.numbers[parent]
        tokens = set()
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role"):
                    tokens |= {*_SPLIT.split((a or b or c).lower())}
        good, bad = sum(map(_is_good, tokens)), sum(map(_is_bad, tokens))
        inside = self.inside[parent]
        if tag in ENCLOSING:
            k = ENCLOSING.index(tag)
            inside = inside[:k] + (inside[k] + 1,) + inside[k + 1 :]
        here = self._node(parent, inside, (up[0] + 1, 0, 0, 0, tag == "p", self.children[parent], up[6] + good, up[7] + bad, bad - good), None)
        self.open_at[tag].append(len(self.tags))
        self.stack.append(here)
        self.tags.append(tag)

    def _innermost(self, tags) -> int:
        """The innermost place on the stack with one of these tags, 0 without any."""
        return max((places[-1] for t in tags if (places := self.open_at.get(t))), default=0)

    def _pop_to(self, k: int) -> None:
        while len(self.tags) > k:
            self._pop()

    def _pop(self) -> None:
        if self.tags[-1] not in INLINE:
            self._new_block = True
        self.end[self.stack.pop()] = len(self.parent)
        self.open_at[self.tags.pop()].pop()

    def _implied(self, tags: set[str], barrier) -> None:
        k = self._innermost(tags)
        if k and k >= self._innermost(barrier):
            self._pop_to(k)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._new_block = True
        k = self._innermost((tag,))
        if k and not (tag in INLINE and self._innermost(BARRIER) > k):
            self._pop_to(k)

    def _put_text(self, raw: str) -> None:
        text = _SPACE.sub(" ", entities.unescape(raw))
        if not text.strip():
            if text and self.text[-1] is not None and not self._new_block:
                self.text[-1] += " "
            return
        parent = self.stack[-1]
        up, inside = self.numbers[parent], self.inside[parent]
        n = len(text)
        here = self._node(parent, inside, (up[0] + 1, n, n if inside[ENCLOSING.index("a")] else 0, len(_PUNCT.findall(text)), 0, self.children[parent], up[6], up[7], 0), text)
        if self._new_block:
            self.breaks.append(here)
        self._new_block = False

    def features(self) -> np.ndarray:
        n = len(self.parent)
        numbers, end, parent = np.array(self.numbers, np.float32), np.array(self.end), np.maximum(np.array(self.parent), 0)
        start = np.arange(n)
        sums = np.zeros((n + 1, 5), np.float64)
        is_text = np.array([t is not None for t in self.text])
        np.cumsum(np.column_stack([numbers[:, 1:5], ~is_text]), axis=0, out=sums[1:])
        chars, links, marks, paragraphs, elements = (sums[end] - sums[start]).T
        total = max(1.0, sums[-1, 0])
        siblings = np.array(self.children)[parent]
        around = (chars[parent] - chars) / np.maximum(1, siblings - 1)
        own = np.column_stack(
            [is_text, numbers[:, 0], np.log1p(chars), links / np.maximum(1, chars), np.log1p(elements), chars / (1 + elements), paragraphs, marks / np.maximum(1, chars), chars / total, sums[:-1, 0] / total, numbers[:, 5], siblings, np.log1p(around), links[parent] / np.maximum(1, chars[parent]), numbers[:, 6:9]]
        )
        return np.column_stack([own, np.array(self.inside)]).astype(np.float32)

    def decode(self, odds: np.ndarray) -> list[int]:
        """The nodes with main text in the likeliest labeling without contradictions."""
        n = len(odds)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        never = np.concatenate([[0], np.cumsum(no)])
        without = never[np.array(self.end)] - never[:-1]
        best = yes.tolist()
        apart = without.tolist()
        for i in range(n - 1, 0, -1):
            best[self.parent[i]] += max(best[i], apart[i])
        out, i = [], 0
        while i < n:
            if best[i] > apart[i]:
                out.append(i)
                i += 1
            else:
                i = self.end[i]
        return out

    def join(self, nodes: list[int]) -> str:
        """Texts of these nodes, white space as one space, blocks apart by one space."""
        breaks, parts, last = {*self.breaks}, [], -1
        for i in nodes:
            if self.text[i] is not None:
                parts.append((" " if i in breaks or any(k in breaks for k in range(last + 1, i)) else "") + self.text[i])
                last = i
        return _SPACE.sub(" ", "".join(parts)).strip(" ")


class Boosted:
    """Gradient-boosted trees for a yes or no, on features binned at quantiles; each tree is complete, of the given depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, smooth: float = 1.0):
        self.depth = depth
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        odds = np.full(len(y), self.base)
        self.trees = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth, np.int64), np.full(2**depth, np.inf, np.float32)
            for level in range(depth):
                width = 2**level
                gain, best = np.full(width, 1e-6), {}
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = node * (len(c) + 1) + binned[:, f]
                    g, h = (np.cumsum(np.bincount(key, v, width * (len(c) + 1)).reshape(width, -1), 1) for v in (grad, hess))
                    score = lambda a, b: a * a / (b + smooth)
                    left, right = score(g[:, :-1], h[:, :-1]), score(g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1])
                    won = left + right - score(g[:, -1:], h[:, -1:])
                    at = won.argmax(1)
                    for k in np.flatnonzero(won[np.arange(width), at] > gain):
                        gain[k], best[int(k)] = won[k, at[k]], (f, int(at[k]))
                right = np.zeros(len(y), np.int64)
                for k, (f, b) in best.items():
                    feature[width - 1 + k], cut[width - 1 + k] = f, cuts[f][b]
                    mine = node == k
                    right[mine] = binned[mine, f] > b
                node = node * 2 + right
            leaf = rate * np.bincount(node, grad, 2**depth) / (np.bincount(node, hess, 2**depth) + smooth)
            odds += leaf[node]
            self.trees.append((feature, cut, leaf))

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def generate(seed: int) -> tuple[str, list[bool]]:
    """A page and, for each of its text runs in order, whether it is main text."""
    r = random.Random(seed)
    labels: list[bool] = []
    vocabulary = ["".join(r.choice(["ta", "re", "on", "mi", "lu", "en", "is", "ko"]) for _ in range(r.randint(1, 4))) for _ in range(60)]

    def text(n: int, good: bool, stop: str = ".") -> str:
        labels.append(good)
        out = " ".join(r.choice(vocabulary) + ("," if r.random() < 0.1 else ".") * (r.random() < 0.15) for _ in range(n)).capitalize() + stop
        return out.replace(".", " &amp; ", 1) if r.random() < 0.1 else out

    def name(*tokens: str) -> str:
        if r.random() < 0.2:
            return ""
        return f' {r.choice(["class", "id"])}="{r.choice(tokens)}{r.choice(["", " box", "-wrap", " col-2"])}"'

    def element(tag: str, attributes: str, *inner: str) -> str:
        return f"<{tag}{attributes}>{''.join(inner)}</{tag}>"

    def links(n: int) -> str:
        return element("ul", "", *(element("li", "", f'<a href="/x">{text(r.randint(1, 3), False, "")}</a>') for _ in range(n)))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.15:
            return f"<p><b>{text(r.randint(1, 80), True)}<br>"
        if kind < 0.25:
            return f"<p>{text(r.randint(3, 30), True, ' ')}<a href='/y'>{text(2, True, '')}</a> {text(r.randint(3, 40), True)}</p>"
        if kind < 0.3:
            return element("ul", "", *(element("li", "", text(r.randint(2, 25), True)) for _ in range(r.randint(2, 5))))
        if kind < 0.35:
            return element("blockquote", "", element("p", "", text(r.randint(5, 40), True)))
        if kind < 0.38:
            return element("table", "", *(element("tr", "", *(element("td", "", text(r.randint(1, 4), True, "")) for _ in range(3))) for _ in range(r.randint(2, 4))))
        if kind < 0.45:
            return element(r.choice(["h2", "h3"]), "", text(r.randint(1, 8), True, ""))
        return element("p", "", text(r.choice([1, 1, 2, 5, 20, 60, 120]), True))

    def comments() -> str:
        one = lambda: element("div", name("comment"), element("b", "", text(1, False, "")), element("p", "", text(r.choice([2, 10, 40]), False)))
        return element(r.choice(["section", "div"]), f' {r.choice(["id", "class"])}="{r.choice(["comments", "commentlist", "reader-comments", "disqus_thread"])}"', *(one() for _ in range(r.randint(1, 5))))

    def content() -> str:
        out = [element("h1", "", text(r.randint(2, 12), True, ""))] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 2, 4, 8, 15])):
            out.append(paragraph())
            if r.random() < 0.08:
                out.append(element("div", name("ad", "advert", "promo", "newsletter", "share social"), text(r.randint(1, 15), False)))
            if r.random() < 0.04:
                out.append(element("aside", "", text(r.randint(1, 15), False)))
            if r.random() < 0.03:
                out.append(element("form", "", element("label", "", text(2, False, "")), "<input name=q>"))
            if r.random() < 0.05:
                out.append(element(r.choice(["section", "div"]), "", paragraph(), element("p", "", text(r.randint(5, 30), True))))
            if r.random() < 0.03:
                out.append(element("figure", "", "<img src=x>", element("figcaption", "", text(r.randint(2, 10), True))))
        if r.random() < 0.15:
            out.append(comments())
        if r.random() < 0.08:
            out.append(element("nav", "", links(r.randint(2, 4))))
        if r.random() < 0.06:
            out.append(element("footer", "", text(r.randint(2, 10), False)))
        if not out:
            out.append(paragraph())
        return "".join(out)

    parts = []
    head = element("head", "", '<meta charset="utf-8">', element("title", "", text(r.randint(2, 10), False, "")), "<style>p{margin:0}</style>", '<script>var t="</p>";</script>')
    if r.random() < 0.4:
        parts.append(element("header", name("header", "masthead", "topbar"), element("div", "", text(r.randint(1, 5), False, "")), element("nav", "", links(r.randint(2, 6))) if r.random() < 0.5 else ""))
    if r.random() < 0.7:
        parts.append(element(r.choice(["nav", "nav", "div"]), ' class="nav menu"' if r.random() < 0.5 else "", links(r.randint(2, 9))))
        if parts[-1].startswith("<div>"):
            parts[-1] = parts[-1].replace("<div>", '<div id="menu">', 1)
    if r.random() < 0.25:
        parts.append(element("div", ' class="cookie notice"', element("p", "", text(r.randint(4, 25), False)), element("button", "", text(1, False, ""))))
    if r.random() < 0.6:
        parts.append(f'<!-- ad --><div class="{r.choice(["ad", "ads banner", "advert", "sponsored"])}">{text(r.randint(2, 15), False)}</div>')
    if r.random() < 0.15:
        parts.append(element("form", name("search", "login"), element("label", "", text(2, False, "")), "<input name=q>", element("button", "", text(1, False, ""))))
    if r.random() < 0.2:
        parts.append(element("aside", name("sidebar", "widget"), element("h3", "", text(2, False, "")), links(r.randint(2, 6))))
    kind = r.random()
    if kind < 0.6:
        parts.append(element("article", name("post", "entry") if r.random() < 0.4 else "", content()))
    elif kind < 0.8:
        parts.append(element("main", "", element(r.choice(["div", "section"]), name("content", "story", "entry"), content())))
    else:
        parts.append(element("div", f' class="{r.choice(["content", "post entry", "article-body", "main text"])}"', content()))
    if r.random() < 0.25:
        parts.append(element("div", ' class="related"', element("h3", "", text(2, False, "")), links(r.randint(2, 5))))
    if r.random() < 0.35:
        parts.append(comments())
    if r.random() < 0.25:
        parts.append(element("div", ' id="sidebar"', element("p", "", text(r.randint(2, 30), False)), links(3)))
    if r.random() < 0.85:
        parts.append(element("footer", name("footer") if r.random() < 0.3 else "", f"&copy; {text(r.randint(2, 15), False)}"))
    else:
        parts.append(element("div", ' class="footer copyright"', text(r.randint(2, 15), False)))
    page = f"<!DOCTYPE html><html>{head}<body>{''.join(parts)}" + "</body></html>" * (r.random() < 0.9)
    return page, labels


_model: list[Boosted] = []
TRAINING_PAGES = 600


def train(pages: int = TRAINING_PAGES) -> Boosted:
    """The trees, from `pages` generated pages."""
    xs, ys = [], []
    for seed in range(pages):
        source, labels = generate(seed)
        page = Page(source)
        y = np.zeros(len(page.parent))
        texts = [i for i, t in enumerate(page.text) if t is not None]
        if len(texts) != len(labels):
            raise ValueError(f"page {seed}: {len(texts)} text runs, {len(labels)} labels")
        for i, good in zip(texts, labels, strict=True):
            while good and i >= 0 and not y[i]:
                y[i] = 1
                i = page.parent[i]
        xs.append(page.features())
        ys.append(y)
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    if not _model:
        _model.append(train())
    shared = pages.sparkSession.sparkContext.broadcast(_model[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                parsed = [Page(x or "") for x in part.column(2).to_pylist()]
                odds = model.odds(np.concatenate([p.features() for p in parsed]))
                ends = np.cumsum([0] + [len(p.parent) for p in parsed])
                texts = [p.join(p.decode(odds[a:b])) for p, a, b in zip(parsed, ends, ends[1:], strict=False)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow(pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html"), run, "page_id long, url string, text string, n_chars long")
