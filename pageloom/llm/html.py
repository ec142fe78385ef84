"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element is described by its tag, the words of its attributes, depth,
subtree text density, link share, and how it stands among its siblings; boosted
trees give the odds that it is content.  A top-down dynamic programme then
chooses the likeliest states: *frame* (holds parts of the page), *content* and
*junk*, where content never becomes frame again and junk holds nothing but
junk, so that a node's choice never contradicts its ancestors'.

The model is fitted on a bounded sample of pages whose semantic elements tell
content from the rest, and on pages recomposed from their blocks in other
layouts (plain ``div``s, other names, side bars, notices, forms, comments),
so that it does not lean on one template.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object select option textarea button canvas audio video".split())
ALWAYS_JUNK = HIDDEN | frozenset("nav footer aside form".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                     "section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
               "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html div section article main aside nav footer header form".split())
TAG_KINDS = ("h1 h2 h3 h4 h5 h6", "p", "div section", "ul ol dl", "li dt dd", "table tr td th tbody", "article", "main", "header", "nav",
             "aside", "footer", "form", "blockquote q", "figure figcaption", "pre code", "body html")
# Words of class, id, role and itemprop attributes, by what they name.
NAMES = {
    "good": "article articlebody content main post entry story text body blog prose",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "head": "header masthead topbar logo branding",
    "foot": "footer copyright legal",
    "side": "sidebar aside side widget related recommended popular trending rail",
    "notice": "cookie cookies consent notice banner alert popup modal newsletter subscribe signup gdpr",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion",
    "share": "share social follow",
    "form": "form login search",
    "talk": "comment comments reply replies discussion disqus respond reader",
}
_NAME_OF = {w: i for i, words in enumerate(NAMES.values()) for w in words.split()}
_KIND_OF = {t: i for i, tags in enumerate(TAG_KINDS) for t in tags.split()}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
KEEP = "data-truth"


class Page(HTMLParser):
    """Flat element table of one page; ``flow`` holds (element, text) in page order, element -1 for a block edge."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.names, self.truth = ["#page"], [-1], [frozenset()], [None]
        self.flow: list[tuple[int, str]] = []
        self.open = [0]
        self.feed(html or "")
        self.close()
        self._free_forms()

    def parse_html_declaration(self, i):
        """As browsers do: outside of foreign elements ``<![`` begins a comment that ends at the next ``>``."""
        if self.rawdata.startswith("<![", i):
            if self.rawdata.startswith("<![CDATA[", i) and any(self.tags[k] in ("svg", "math") for k in self.open):
                end = self.rawdata.find("]]>", i)
                return end + 3 if end >= 0 else -1
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def _free_forms(self) -> None:
        """A form around most of the page's visible text is its frame, as in pages that are one form: it counts as a ``div``."""
        if "form" not in self.tags:
            return
        hidden, size = self.hidden(), [0] * len(self.tags)
        for node, text in self.flow:
            if node >= 0 and not hidden[node]:
                size[node] += len("".join(text.split()))
        for i in range(len(self.tags) - 1, 0, -1):
            size[self.parents[i]] += size[i]
        self.tags = ["div" if tag == "form" and 2 * n > size[0] else tag for tag, n in zip(self.tags, size)]

    def _leave(self, until: int) -> None:
        while len(self.open) > until:
            if self.tags[self.open.pop()] not in INLINE:
                self.flow.append((-1, " "))

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            for i in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[i]]
                if name == "p":
                    self._leave(i)
                    break
                if name in SCOPES or name in ("td", "th", "li"):
                    break
        if tag in SAME_CLOSES:
            for i in range(len(self.open) - 1, 0, -1):
                name = self.tags[self.open[i]]
                if name in SAME_CLOSES[tag]:
                    self._leave(i)
                    break
                if name in SCOPES:
                    break
        if tag == "body" and self.open[1:] and self.tags[self.open[-1]] == "head":
            self._leave(len(self.open) - 1)
        if tag not in INLINE:
            self.flow.append((-1, " "))
        if tag in VOID:
            return
        found, truth = set(), None
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop") and value:
                found.update(_WORDS.findall(_CAMEL.sub(" ", value).lower()))
            elif key == KEEP:
                truth = value == "1"
        self.open.append(len(self.tags))
        self.tags.append(tag)
        self.parents.append(self.open[-2])
        self.names.append(frozenset(_NAME_OF[w] for w in found if w in _NAME_OF))
        self.truth.append(truth)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tags[self.open[-1]] == tag:
            self._leave(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[i]]
            if name == tag:
                self._leave(i)
                return
            if tag in INLINE and name not in INLINE:
                return
        if tag in ("p", "br"):
            self.flow.append((-1, " "))

    def handle_data(self, data):
        self.flow.append((self.open[-1], data))

    def hidden(self) -> list[bool]:
        out = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            out[i] = out[self.parents[i]] or self.tags[i] in HIDDEN
        return out


def describe(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of a page's elements, and each element's own visible characters."""
    n, parents, hidden = len(page.tags), page.parents, page.hidden()
    own, marks, start = np.zeros(n), np.zeros(n), np.full(n, -1.0)
    seen = 0
    for node, text in page.flow:
        if node >= 0 and not hidden[node]:
            size = len(text) - text.count(" ") - text.count("\n")
            if size:
                if start[node] < 0:
                    start[node] = seen
                own[node] += size
                marks[node] += sum(map(text.count, ".,;!?"))
                seen += size
    chars, links, inner, commas, paragraphs = own.copy(), np.zeros(n), np.ones(n), marks.copy(), np.zeros(n)
    for i in range(n):
        links[i] = own[i] if page.tags[i] == "a" else 0
        paragraphs[i] = page.tags[i] == "p"
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if page.tags[i] == "a":
            links[i] = chars[i]
        chars[p] += chars[i]
        links[p] += links[i]
        inner[p] += inner[i]
        commas[p] += commas[i]
        paragraphs[p] += paragraphs[i]
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    total = max(1.0, chars[0])
    depth, brothers, place, alike, child_chars = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        place[i] = brothers[p]
        brothers[p] += 1
        child_chars[p] += chars[i]
        same[p, page.tags[i]] = same.get((p, page.tags[i]), 0) + 1
    above = np.array(parents)
    count = np.maximum(1, brothers[above])
    for i in range(1, n):
        alike[i] = same[parents[i], page.tags[i]]
    named, kind = np.zeros((n, len(NAMES))), np.zeros((n, len(TAG_KINDS)))
    over = np.zeros((n, 4))  # any good name, any other name, article or main, any junk tag above
    for i in range(1, n):
        p = parents[i]
        for k in page.names[i]:
            named[i, k] = 1
        if page.tags[i] in _KIND_OF:
            kind[i, _KIND_OF[page.tags[i]]] = 1
        over[i] = np.maximum(over[p], (named[p, 0], named[p, 1:].any(), kind[p, 6] or kind[p, 7], page.tags[p] in ALWAYS_JUNK or kind[p, 8]))
    columns = [depth, np.log1p(chars), np.log1p(own), links / np.maximum(1, chars), np.log1p(inner), chars / inner,
               commas / np.maximum(1, chars), np.log1p(paragraphs), chars / total, np.maximum(0, start) / total,
               (np.maximum(0, start) + chars) / total, place / count, count, alike / count,
               np.log1p(np.maximum(0, child_chars[above] - chars) / np.maximum(1, count - 1)), chars[above] / total]
    return np.column_stack([*columns, named, kind, over]), own


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the logistic loss."""

    depth: int = 4
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.splits:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2 ** self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Fit :class:`Trees` with histogram splits (second-order gains, ties to the first feature and cut)."""
    model = Trees(depth)
    if not len(x) or y.min() == y.max():
        model.base = 8.0 * (2 * float(y[0]) - 1) if len(y) else -8.0
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    score = np.zeros(len(x))
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, nodes = 2 ** level - 1, 2 ** level
            local = at - first
            best = np.full(nodes, 1e-6)
            chosen = np.full(nodes, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                key = local * width + coded[:, j]
                gs = np.bincount(key, g, nodes * width).reshape(nodes, width)
                hs = np.bincount(key, h, nodes * width).reshape(nodes, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga ** 2 / (ha + 1)
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                better = value > best + 1e-9
                best[better], chosen[better] = value[better], j
                feature[first:first + nodes][better] = j
                cut[first:first + nodes][better] = c[top[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        end = at - inner
        leaf = rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + 1)
        score += leaf[end]
        model.splits.append((feature, cut, leaf))
    return model


def decode(page: Page, odds: np.ndarray, own: np.ndarray, start: float = 1.0, stop: float = 2.0) -> list[bool]:
    """Which elements are content, by the best consistent labelling.

    An element's own text votes with its log-likelihood, weighted by its
    length; beginning content costs ``start`` and junk inside content ``stop``.
    """
    n = len(page.tags)
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    weight = np.log1p(own) + 0.05
    weight[0] = 0
    frame, content, junk = weight * no, weight * yes, weight * no
    for i in range(n):
        if page.tags[i] in ALWAYS_JUNK:
            frame[i] = content[i] = -1e9
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        frame[p] += max(frame[i], content[i] - start, junk[i])
        content[p] += max(content[i], junk[i] - stop)
        junk[p] += junk[i]
    states = [0] * n
    for i in range(1, n):
        above = states[page.parents[i]]
        if above == 0:
            options = ((frame[i], 0), (content[i] - start, 1), (junk[i], 2))
        elif above == 1:
            options = ((content[i], 1), (junk[i] - stop, 2))
        else:
            options = ((0.0, 2),)
        states[i] = max(options, key=lambda o: o[0])[1]
    return [s == 1 for s in states]


def text_of(page: Page, kept: list[bool]) -> str:
    """Text of kept elements; blocks joined and white space folded to single spaces."""
    hidden = page.hidden()
    return " ".join("".join(text for node, text in page.flow if node < 0 or kept[node] and not hidden[node]).split())


def semantic_truth(page: Page) -> list[bool] | None:
    """Content by ``article`` or ``main`` and by names of junk; None if a page has neither."""
    if "article" not in page.tags and "main" not in page.tags:
        return None
    state = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        above = state[page.parents[i]]
        junk = page.tags[i] in ALWAYS_JUNK or any(k > 0 for k in page.names[i])
        state[i] = 2 if above == 2 or junk else 1 if above == 1 or page.tags[i] in ("article", "main") else 0
    return [s == 1 for s in state]


def blocks_of(page: Page, wanted: list[bool]) -> list[str]:
    """Normalised texts of the blocks among the wanted elements."""
    out, now = [], []
    for node, text in page.flow + [(-1, " ")]:
        if node < 0:
            joined = " ".join("".join(now).split())
            if joined:
                out.append(joined)
            now = []
        elif wanted[node]:
            now.append(text)
    return out


def recompose(rng: Random, good: list[str], other: list[str]) -> str:
    """A page in another layout from content blocks and blocks of other pages, with its truth marked."""
    def some(k: int) -> list[str]:
        return [escape(b) for b in rng.choices(other, k=k)]

    def wrap(tag: str, name: str | None, body: str, keep: bool | None = None) -> str:
        attribute = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        mark = "" if keep is None else f' {KEEP}="{int(keep)}"'
        return f"<{tag}{attribute}{mark}>{body}</{tag}>"

    def named(kind: str) -> str:
        return rng.choice(NAMES[kind].split()) + rng.choice(["", "", "-box", "_area", " wide"])

    def junk() -> str:
        kind = rng.choice(["nav", "head", "foot", "side", "notice", "ad", "share", "form", "talk"])
        tags = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}
        tag = rng.choice([tags.get(kind, "div"), "div", "div"])
        if kind in ("nav", "share"):
            words = " ".join(some(1)).split()[:rng.randint(3, 9)]
            body = "<ul>" + "".join(f'<li><a href="#">{w}</a></li>' for w in words) + "</ul>"
        elif kind == "talk":
            body = "".join(f'<div class="{rng.choice(["comment", "reply"])}"><p>{b}</p></div>' for b in some(rng.randint(1, 4)))
        elif kind == "side":
            body = "<h3>" + some(1)[0][:30] + "</h3>" + "".join(f'<p><a href="#">{b[:60]}</a></p>' for b in some(rng.randint(1, 4)))
        else:
            b = some(1)[0]
            body = rng.choice([f"<p>{b}</p>", b, b[:80], f"<span>{b[:120]}</span>"])
        plain = tag != "div" and rng.random() < 0.5
        return wrap(tag, None if plain else named(kind), body, False)

    inside = [f"<h1>{escape(good[0])}</h1>"] if good and rng.random() < 0.8 else []
    for b in good:
        tag = rng.choices(["p", "h2", "li", "blockquote", "div"], [12, 1, 1, 1, 1])[0]
        body = escape(b)
        body = f"<ul><li>{body}</li></ul>" if tag == "li" else f"<{tag}>{body}</{tag}>"
        inside.append(body)
        if rng.random() < 0.08:
            inside.append(junk())
    tag = rng.choice(["article", "main", "div", "div", "section", "td"])
    core = wrap("div" if tag == "td" else tag, None if tag in ("article", "main") and rng.random() < 0.6 or rng.random() < 0.25
                else named("good"), "".join(inside), True)
    if tag == "td":
        core = f"<table><tr><td>{core}</td></tr></table>"
    if rng.random() < 0.4:
        core = f"<div>{core}{junk() if rng.random() < 0.5 else ''}</div>"
    before, after = [junk() for _ in range(rng.randint(0, 3))], [junk() for _ in range(rng.randint(0, 4))]
    return f"<html><head><title>t</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"


def marked_truth(page: Page) -> list[bool]:
    state = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        state[i] = state[page.parents[i]] if page.truth[i] is None else page.truth[i]
    return state


def learn(pages: DataFrame, html: str = "html", sample_pages: int = 300, versions: int = 3, seed: int = 31) -> Trees:
    """Fit on at most ``sample_pages`` pages, drawn by a hash of their text.

    The bound is that of the fit only.  Null and empty pages, and pages without
    ``article`` or ``main``, teach nothing; if none is left, the blocks'
    stand-ins are short and the model rests on recomposed pages alone.
    """
    usable = pages.where(F.length(html) > 0).select(F.col(html).alias("html"))
    total = usable.count()
    share = min(1.0, 2 * sample_pages / max(1, total))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(seed), "html"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = [r.html for r in drawn.orderBy(F.xxhash64("html"), "html").limit(sample_pages).collect()]
    rng = Random(seed)
    known, good, other = [], [], ["Short stand-in text, for want of pages.", "Home", "About us and more"]
    for page in map(Page, rows):
        truth = semantic_truth(page)
        if truth is None:
            continue
        known.append((page, truth))
        good.append(blocks_of(page, truth))
        hidden = page.hidden()
        other += blocks_of(page, [not t and not h for t, h in zip(truth, hidden)])
    good = [g for g in good if g] or [other]
    other += [b for g in good for b in g[1:3]]
    for g in good * max(versions, 600 // len(good)):
        page = Page(recompose(rng, g[:rng.randint(1, 14)], other))
        known.append((page, marked_truth(page)))
    xs, ys, ws = [], [], []
    for page, truth in known:
        x, own = describe(page)
        inside = own * np.array(truth)
        whole = own.copy()
        for i in range(len(own) - 1, 0, -1):
            inside[page.parents[i]] += inside[i]
            whole[page.parents[i]] += whole[i]
        use = (whole > 0) & ~np.array(page.hidden())
        use[0] = False
        xs.append(x[use])
        ys.append((2 * inside > whole)[use].astype(float))
        ws.append(1 / np.sqrt(use.sum() + 1.0) * (1 + np.log1p(own[use])))
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws) * 4)


def main_texts(model: Trees, htmls: list[str | None]) -> list[str]:
    pages = [Page(h) for h in htmls]
    described = [describe(p) for p in pages]
    odds = model.odds(np.concatenate([x for x, _ in described])) if pages else np.zeros(0)
    out, at = [], 0
    for page, (x, own) in zip(pages, described):
        out.append(text_of(page, decode(page, odds[at:at + len(x)], own)))
        at += len(x)
    return out


def extract(pages: DataFrame, model: Trees, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole page; null and empty pages give an empty text.

    A column named as ``text`` is replaced; repeated rows come out alike.
    """
    pages = pages.drop(text) if text != html else pages
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def main_text(htmls: pd.Series) -> pd.Series:
        values = [h if isinstance(h, str) else None for h in htmls]
        texts: list[str] = []
        for at in range(0, len(values), 256):
            texts += main_texts(shared.value, values[at:at + 256])
        return pd.Series(texts, dtype=object)

    return pages.withColumn(text, main_text(html))
