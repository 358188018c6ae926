"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A tolerant scanner turns a page into leaf blocks in page order, each with its open block elements, the words of their classes and
ids, and its text. Open elements are linked nodes that carry the sum of their features' weights, so time and memory follow the size
of the page, however deep or broken its markup is. The field labels blocks as main text or not from ancestor-tag and text features and from neighbouring labels;
its weights are fitted by gradient ascent on the likelihood of generated labelled pages (TRAIN_PAGES, a fixed bound, varied
templates: semantic tags or classed divisions, menus, sidebars, notices, adverts, forms, reader comments, unclosed tags), and pages
are decoded by Viterbi. Character references are decoded, white space in a block becomes one blank, blocks are joined by an empty
line. Whole pages are read; nothing is cut off. Only the contents of scripts, styles, templates and text areas never become blocks;
all other text is judged by the field. A tag without an end is text; once quotes have hidden the end of a tag, they count as plain
characters in the rest of the page; an unclosed comment, script or style reaches to the end.

Defined cases: null and empty pages, and pages without main text, give the empty text; null ids and urls are kept; repeated rows
give repeated results; an empty table gives an empty result; equal path weights go to "main text". Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

TRAIN_PAGES = 250

# Element names of HTML by how they shape blocks.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "body": ("head", "title")}
INSIDE_P = frozenset("button label select option optgroup noscript".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile("""['">]""")
_CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """An open element: its tag, the words of class and id, the element around it, and the weight of the whole context."""

    __slots__ = ("tag", "words", "parent", "weight", "leaf")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.weight = self.leaf = 0.0

    def path(self) -> tuple:
        out, node = [], self
        while node.parent is not None:
            out.append((node.tag, node.words))
            node = node.parent
        return tuple(reversed(out))


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends a tag, -1 without one. last: where each kind of quote occurs last; one after it is no quote."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        q = m[0]
        if q == ">":
            return m.start()
        at = page.index(q, m.end()) + 1 if m.start() < last[q] else m.end()


def blocks(page: str, weights: dict[str, float] | None = None) -> list[tuple[Node, str, int]]:
    """Leaf blocks: the innermost open element, the text, the number of its characters in links."""
    weight_of = (weights or {}).get
    top = Node("", frozenset(), None)
    top.leaf = weight_of("leaf:", 0.0)
    stack, text, out = [top], [], []
    seen: Counter[str] = Counter()  # features of the open elements
    open_tags: Counter[str] = Counter()
    links = in_link = at = 0
    last = {q: page.rfind(q) for q in "\"'"}
    unclosed = set()

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((stack[-1], joined, links))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            if in_link:
                links += len(piece)

    def push(tag: str, words: frozenset) -> None:
        node = Node(tag, words, stack[-1])
        node.weight, node.leaf = stack[-1].weight, weight_of(f"leaf:{tag}", 0.0)
        for f in (f"in:{tag}", *(f"word:{w}" for w in words)):
            node.weight += 0.0 if seen[f] else weight_of(f, 0.0)
            seen[f] += 1
        open_tags[tag] += 1
        stack.append(node)

    def pop() -> str:
        node = stack.pop()
        for f in (f"in:{node.tag}", *(f"word:{w}" for w in node.words)):
            seen[f] -= 1
        open_tags[node.tag] -= 1
        return node.tag

    while True:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        if page.startswith("<!--", i):
            add(page[at:i])
            at = page.find("-->", i + 4) + 3
            if at < 3:
                break
            continue
        declared, closing = page[i + 1 : i + 2] in ("!", "?"), page[i + 1 : i + 2] == "/"
        m = None if declared else _NAME.match(page, i + 1 + closing)
        if m is None and not declared:
            add(page[at : i + 1])
            at = i + 1
            continue
        e = page.find(">", i) if declared else tag_end(page, m.end(), last)
        if e < 0 and not declared:
            last = {q: -1 for q in last}
            e = page.find(">", i)
        if e < 0:  # no further tag in this page
            add(page[at:])
            break
        add(page[at:i])
        at = e + 1
        if declared:
            continue
        tag, attributes = m[0].lower(), page[m.end() : e]
        if tag in RAW and not closing:
            end = None if tag in unclosed else _CLOSERS[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                if open_tags[tag]:
                    while pop() != tag:
                        pass
                    in_link = 0
            else:
                drop = CLOSES_ITSELF.get(tag, ())
                while stack[-1].tag in drop or (stack[-1].tag == "p" and tag not in INSIDE_P):
                    pop()
                if not attributes.endswith("/"):
                    push(tag, frozenset(w for g in _NAMED.findall(attributes) for w in _WORD.findall("".join(g).lower())))
    flush()
    return out


def context_features(stack: tuple) -> list[str]:
    tags = [t for t, _ in stack]
    found = {f"in:{t}" for t in tags} | {f"word:{w}" for _, words in stack for w in words}
    return sorted(found | {f"leaf:{tags[-1] if tags else ''}"})


def text_features(text: str, links: int) -> list[str]:
    n = len(text)
    return [f"size:{min(7, n.bit_length())}", f"link:{min(3, 4 * links // max(1, n))}", f"stop:{text[-1] in '.!?:;…。'}", f"mark:{any(c in text for c in '©|»›')}"]


class Field:
    """Weights of the chain: one for each feature (towards main text), 2 x 2 for neighbours, 2 for the first label."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def blocks(self, page: str) -> list[tuple[Node, str, int]]:
        return blocks(page, self.weights)

    def emission(self, node: Node, text: str, links: int) -> float:
        """The score of a block of self.blocks()."""
        return node.weight + node.leaf + sum(self.weights.get(f, 0.0) for f in text_features(text, links))

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b, back = float(self.first[0]), float(self.first[1]) + scores[0], []
        for e in scores[1:]:
            back.append((a + p00 < b + p10, a + p01 <= b + p11))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + e
        y = [int(b >= a)]
        for to_0, to_1 in reversed(back):
            y.append(int(to_1 if y[-1] else to_0))
        return y[::-1]

    def extract(self, page: str | None) -> str:
        found = self.blocks(page or "")
        keep = self.decode([self.emission(*b) for b in found])
        return "\n\n".join(b[1] for b, k in zip(found, keep, strict=True) if k)


# --- training -------------------------------------------------------------------------------------------------------------


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A generated page and the labels of its leaf blocks in order."""
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(1, 9)))
    said = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    para = lambda: " ".join(said(1, 14).capitalize() + r.choice([".", ".", "!", "?"]) for _ in range(r.randint(1, 6)))
    out, labels = [], []

    def put(markup: str, y: int | None = None) -> None:
        out.append(markup)
        if y is not None:
            labels.append(y)

    def menu(tag: str, name: str) -> None:
        put(f"<{tag}{name}><ul>")
        for _ in range(r.randint(1, 8)):
            put(f'<li><a href="/{word()}">{said(1, 3)}</a></li>' if r.random() < 0.8 else f"<li><a href='/x'>{said(1, 3)}</a>", 0)
        put(f"</ul></{tag}>")

    def aside(tag: str, name: str, n: int = 2) -> None:
        put(f"<{tag}{name}>")
        for _ in range(r.randint(1, n)):
            shape = r.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "{}"])
            put(shape.format(r.choice([para, lambda: said(1, 9)])()), 0)
            if shape == "{}":
                break
        put(f"</{tag}>")

    named = lambda *names: f' class="{r.choice(names)}"' if r.random() < 0.8 else f' id="{r.choice(names)}"'
    extras = [
        lambda: aside("div", named("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner")),
        lambda: aside("aside", r.choice(["", named("sidebar", "related", "widget", "ad", "promo")]), 4),
        lambda: aside("div", named("sidebar", "related", "widget", "share", "social", "breadcrumb"), 4),
        lambda: aside("div", named("cookie", "cookie-notice", "notice", "consent", "alert", "newsletter", "subscribe")),
        lambda: put(f"<form{r.choice(['', named('search', 'login')])}><label>{said(1, 3)}</label><input name=q><button>{word()}</button></form>") or labels.extend([0, 0]),
    ]
    comments = lambda: aside(r.choice(["section", "div"]), named("comments", "comment-list", "responses", "comment"), 6)
    put(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{said(2, 8)}</title>", 0)
    put("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    frames = r.choice([0, 0, 1, 1, 2, 3])
    put("".join(f"<div{r.choice(['', named('page', 'wrapper', 'container', 'site', 'layout')])}>" for _ in range(frames)))
    if r.random() < 0.5:
        aside("header", r.choice(["", named("site-header", "top")]))
    if r.random() < 0.85:
        menu("nav", r.choice(["", named("menu", "navbar")])) if r.random() < 0.7 else menu("div", named("menu", "nav", "navigation"))
    for x in r.sample(extras, r.randint(0, 3)):
        x()
    put("<!-- ad -->")
    tag, name = r.choice([("article", ""), ("article", named("post")), ("main", ""), ("div", named("content", "article", "post-body", "entry", "story"))])
    put(f"<{tag}{name}>")
    if r.random() < 0.9:
        put(f"<h1>{said(1, 9)}{r.choice(['', '.'])}</h1>", 1)
    for _ in range(r.randint(0 if r.random() < 0.1 else 1, 12)):
        x = r.random()
        if x < 0.62:
            put(f"<p>{para() if r.random() < 0.85 else said(1, 3)}{r.choice(['</p>', '</p>', ''])}", 1)
        elif x < 0.7:
            put(f"<p><b>{para()}<br>", 1)
        elif x < 0.76:
            put(f"<h2>{said(1, 6)}</h2>", 1)
        elif x < 0.8:
            put(f"<blockquote>{para()}</blockquote>", 1)
        elif x < 0.84:
            put("<ul>")
            for _ in range(r.randint(1, 4)):
                put(f"<li>{said(2, 12)}</li>", 1)
            put("</ul>")
        elif x < 0.87:
            put("<table>")
            for _ in range(r.randint(1, 3)):
                put(f"<tr><td>{said(1, 4)}", 1)
                put(f"<td>{said(1, 4)}</tr>", 1)
            put("</table>")
        elif x < 0.89:
            put(f"<pre>{said(2, 20)}</pre>", 1)
        elif x < 0.93:
            put(f'<p>{said(2, 9)} <a href="/{word()}">{said(1, 3)}</a> {said(2, 9)}.</p>', 1)
        else:
            r.choice(extras)()
    if r.random() < 0.15:
        comments()
    put(f"</{tag}>")
    if r.random() < 0.3:
        comments()
    for x in r.sample(extras, r.randint(0, 2)):
        x()
    if r.random() < 0.9:
        put(f"<footer{r.choice(['', named('footer', 'site-footer')])}>&copy; {said(1, 4)} &middot; {said(2, 12)}{r.choice(['', '.'])}</footer>", 0)
    put("</div>" * frames + r.choice(["</body></html>", ""]))
    return "".join(out), labels


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    """log-sum-exp over an axis of two entries."""
    x, y = np.moveaxis(a, axis, 0)
    return np.logaddexp(x, y)


def likelihood(w: np.ndarray, flat: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the pages' labels and its gradient. flat: features of all blocks, pages one after another; y and
    mask have a row for each page. w: feature weights, then 2 x 2 for neighbours and 2 for the first label. Sums run over all pages
    at once, forward and backward."""
    pages, longest = y.shape
    at = np.arange(pages)
    pairs, first = w[-6:-2].reshape(2, 2), w[-2:]
    e = np.zeros((pages, longest, 2))
    e[mask, 1] = flat @ w[:-6].astype(flat.dtype)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = first + e[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.where(mask[:, t, None], _lse(alpha[:, t - 1, :, None] + pairs, 1) + e[:, t], alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        beta[:, t] = np.where(mask[:, t + 1, None], _lse(pairs + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
    z = _lse(alpha[:, -1], 1)
    p = np.exp(alpha + beta - z[:, None, None])
    both = mask[:, 1:]
    joint = np.exp(alpha[:, :-1, :, None] + pairs + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    g = np.zeros_like(w)
    g[:-6] = (y - p[:, :, 1])[mask].astype(flat.dtype) @ flat
    g[-6:-2] = (seen - joint[both].sum(0)).ravel()
    g[-2:] = np.bincount(y[at, 0], minlength=2) - p[:, 0].sum(0)
    value = (e[:, :, 1] * y)[mask].sum() + (seen * pairs).sum() + first[y[at, 0]].sum() - z.sum()
    return float(value / pages), g / pages


@lru_cache
def fit(pages: int = TRAIN_PAGES, seed: int = 5, rounds: int = 80) -> Field:
    """Maximum likelihood, with a small penalty on weights, by Adam."""
    r = random.Random(seed)
    data = []
    while len(data) < pages:
        page, y = labelled_page(r)
        b = blocks(page)
        assert len(b) == len(y), "a labelled page has a label for each block"
        if b:
            data.append(([context_features(s.path()) + text_features(t, n) for s, t, n in b], y))
    names = {f: i for i, f in enumerate(sorted({f for x, _ in data for fs in x for f in fs}))}
    longest = max(len(y) for _, y in data)
    flat = np.zeros((sum(len(y) for _, y in data), len(names)), np.float32)
    y, mask, at = np.zeros((len(data), longest), int), np.zeros((len(data), longest), bool), 0
    for k, (fs, labels) in enumerate(data):
        mask[k, : len(labels)] = True
        y[k, : len(labels)] = labels
        for f in fs:
            flat[at, [names[n] for n in f]] = 1
            at += 1
    w, m, v = np.zeros(len(names) + 6), 0.0, 0.0
    for step in range(1, rounds + 1):
        g = likelihood(w, flat, y, mask)[1] - 0.002 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({n: float(w[i]) for n, i in names.items()}, w[-6:-2].reshape(2, 2), w[-2:])


def extract(pages: DataFrame, field: Field | None = None, html_column: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(field or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = [held.value.extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
