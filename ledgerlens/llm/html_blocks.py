"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks (runs of text between block-level tags).  Every block has a
vector of its tag path (names, classes and ids of the open elements; common ones have a place of their own,
others are hashed), of its hashed words, and of its length, links and place.  A bidirectional LSTM in numpy reads the whole sequence in both directions
and labels every block as main text or not, so a block's label rests on the whole document.

The labeller is trained here on at most TRAIN_PAGES pages of the table (those with the least hash of
their address; pages over TRAIN_CHARS characters are no training pages), each also with foreign blocks
put in (menus, notices, adverts, sidebars, forms, comments, filled with other pages' text) and on pages of other
layouts composed of the same texts: frames of any name or none, table cells, text between line breaks, lists,
quotes, code, definitions, figures, inner tables.  Training labels come from what a composed block stands for; on
the table's own pages from the elements that a block stands in and, without a frame, from the share of link text
of the blocks of its kind over the page.

Defined results: null or empty html and pages without main text give an empty text; unclosed, crossing
and unknown tags are read leniently; repeated rows and null ids keep a row each; extra columns are
ignored; an empty table gives an empty result.  Pages are read whole.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .tokens import buffers, word_hashes

TRAIN_PAGES, TRAIN_CHARS, EPOCHS, RATE, HIDDEN, SEED = 160, 100_000, 30, 0.01, 20, 7
UNKNOWN, LEAF, WORDS, NUMBERS = 64, 64, 32, 5

# FIXED VALUES: element names by role, and the words in names, classes and ids that mark other than main text
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
UNSEEN = set("script style noscript template iframe svg math xmp noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
OTHER = set("head title nav header footer aside form button select textarea menu dialog ad ads advert adverts advertisement banner cookie consent notice notices alert popup modal sidebar side menu menus navbar navigation breadcrumb breadcrumbs comment comments respond replies share social related promo promotion sponsor sponsored newsletter subscribe signup login search widget toolbar copyright masthead disclaimer".split())
MAIN = set("article main content post story entry body".split())

#: places of a path vector: one for each of these names, then UNKNOWN shared ones
KNOWN = {w: i for i, w in enumerate(sorted(BLOCKS | OTHER | MAIN | {"a"}))}
PATH = len(KNOWN) + UNKNOWN
SIZE = PATH + LEAF + WORDS + NUMBERS

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "links")

    def __init__(self, path, text, links):
        self.path, self.text, self.links = path, text, links


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order. A path is a tuple of element names with the names of their class and id."""
    out, text, links, stack = [], [], 0, []
    path, in_link, at = (), 0, 0

    def cut():
        nonlocal text, links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(path, joined, links))
            text, links = [], 0

    def pop(n):
        nonlocal path, in_link
        for name, _ in stack[n:]:
            in_link -= name == "a"
        del stack[n:]
        path = tuple(x for _, x in stack)

    while at < len(html):
        m = _TAG.search(html, at)
        chunk = html[at : m.start() if m else len(html)]
        if chunk:
            plain = unescape(chunk) if "&" in chunk else chunk
            text.append(plain)
            links += len(plain) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
            continue
        if m[1]:
            if name in BLOCKS:
                cut()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in BLOCKS and any(x in BLOCKS for x, _ in stack[i:]):
                        cut()
                    pop(i)
                    break
            continue
        if name in BLOCKS:
            cut()
            for i in range(len(stack) - 1, -1, -1):  # what this start tag closes
                if stack[i][0] in CLOSES.get(name, ()) or (stack[i][0] == "p" and name not in ("option", "optgroup")):
                    pop(i)
                    break
                if stack[i][0] in HOLDS.get(name, ()) or stack[i][0] in ("div", "td", "th", "article", "section", "body", "main"):
                    break
        if name in VOID or m[4]:
            continue
        label = name
        if m[3] and "=" in m[3]:
            marks = " ".join(a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[3])).lower()
            label = " ".join([name, *_NAME.findall(marks)])
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, at)
            inner = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
            cut()
            if name not in UNSEEN and inner.strip():
                out.append(Block((*path, label), " ".join(unescape(inner).split()), 0))
            continue
        stack.append((name, label))
        in_link += name == "a"
        path = (*path, label)
    cut()
    return out


def taught(page: list[Block]) -> list[int]:
    """Training labels, by the elements around each block."""
    # an element is a title of the page, a class of that name is often the article's
    marks = [{w for label in b.path for i, w in enumerate(label.split()) if i == 0 or w not in ("title", "head")} for b in page]
    framed = any(m & {"article", "main"} for m in marks)
    sizes: dict[tuple, list[int]] = {}
    for b in page:  # text and link text of the blocks of a path
        total = sizes.setdefault(b.path, [0, 0])
        total[0] += len(b.text)
        total[1] += b.links
    out = []
    for b, m in zip(page, marks, strict=True):
        body = (m & {"article", "main"}) if framed else 2 * sizes[b.path][1] < sizes[b.path][0]
        out.append(int(bool(body) and not m & OTHER))
    return out


def _mark(word: str, size: int, salt: int) -> int:
    return zlib.crc32(word.encode(), salt) % size


_paths: dict[tuple, np.ndarray] = {}


def path_vector(path: tuple) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        v = np.zeros(PATH + LEAF, np.float32)
        for label in path:
            for w in label.split():
                v[KNOWN[w] if w in KNOWN else len(KNOWN) + _mark(w, UNKNOWN, 1)] = 1.0
        blocks_only = [label.split()[0] for label in path if label.split()[0] in BLOCKS]
        if blocks_only:
            v[PATH + _mark(blocks_only[-1], LEAF, 2)] = 1.0
        _paths[path] = v
    return _paths[path]


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """One row per block of every page."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, SIZE), np.float32) for _ in pages]
    x = np.zeros((len(flat), SIZE), np.float32)
    x[:, : PATH + LEAF] = [path_vector(b.path) for b in flat]
    words, at = word_hashes(*buffers(pa.array([b.text for b in flat], pa.string())))
    n = np.diff(at)
    counts = np.bincount(np.repeat(np.arange(len(flat)), n) * WORDS + (words >> np.uint64(59)).astype(np.int64), minlength=len(flat) * WORDS)
    counts = counts.reshape(len(flat), WORDS)
    x[:, PATH + LEAF : PATH + LEAF + WORDS] = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1)[:, None] / 2
    sizes = np.array([len(b.text) for b in flat], np.float32)
    x[:, -5] = np.log1p(sizes) / 8
    x[:, -4] = 2 * np.array([b.links for b in flat]) / np.maximum(sizes, 1)
    x[:, -3] = n <= 3
    ends = np.cumsum([len(p) for p in pages])
    out = np.split(x, ends[:-1])
    for page in out:
        if len(page):
            page[:, -2] = np.arange(len(page)) / len(page)
            page[:, -1] = 1.0
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM with a logistic output on both states; pages are padded at their end."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"out": make(2 * hidden, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": make(SIZE, 4 * hidden), f"{d}h": make(hidden, 4 * hidden)}
        self.hidden = hidden

    def _direction(self, d: str, x: np.ndarray, keep: bool):
        """x: time, page, vector. States of every step; with ``keep`` what the gradients need."""
        time, page, _ = x.shape
        n, wh = self.hidden, self.p[f"{d}h"]
        h, c = np.zeros((page, n), np.float32), np.zeros((page, n), np.float32)
        gates = (x.reshape(time * page, -1) @ self.p[f"{d}x"]).reshape(time, page, 4 * n)
        out, kept = np.zeros((time, page, n), np.float32), []
        for t in range(time):
            z = gates[t] + h @ wh
            i, f, o = np.split(_sigmoid(z[:, : 3 * n]), 3, axis=1)
            g = np.tanh(z[:, 3 * n :])
            before = (h, c)
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep:
                kept.append((i, f, o, g, s, *before))
        return out, kept

    def _read(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        back = np.where(np.arange(len(x))[:, None] < lengths, lengths - 1 - np.arange(len(x))[:, None], np.arange(len(x))[:, None])
        across = np.arange(x.shape[1])[None, :]
        forward, kf = self._direction("f", x, keep)
        backward, kb = self._direction("b", x[back, across], keep)
        states = np.concatenate([forward, backward[back, across]], axis=2)
        return states, (states @ self.p["out"])[:, :, 0] + self.p["bias"], (kf, kb, back, across)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((max(1, lengths.max()), len(pages), SIZE), np.float32)
        for i, p in enumerate(pages):
            x[: len(p), i] = p
        return x, lengths

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Per page, whether each block is main text."""
        out: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            some = order[at : at + 128]
            while len(some) > 1 and len(pages[some[-1]]) * len(some) > 20_000:
                some = some[: len(some) // 2]
            x, lengths = self.padded([pages[i] for i in some])
            _, score, _ = self._read(x, lengths)
            for j, i in enumerate(some):
                out[i] = score[: lengths[j], j] > 0
            at += len(some)
        return out

    def _back(self, d: str, x, kept, dh_out, grads):
        n, wh = self.hidden, self.p[f"{d}h"]
        dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
        dz = np.zeros((*x.shape[:2], 4 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, s, h0, c0 = kept[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - s * s)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[f"{d}h"] += h0.T @ dz[t]
            dh, dc = dz[t] @ wh.T, dc * f
        grads[f"{d}x"] += x.reshape(-1, SIZE).T @ dz.reshape(-1, 4 * n)

    def gradients(self, x, lengths, y):
        """Cross-entropy gradients over the blocks of a padded batch (y: time, page)."""
        states, score, (kf, kb, back, across) = self._read(x, lengths, True)
        mask = np.arange(len(x))[:, None] < lengths
        d = np.where(mask, _sigmoid(score) - y, 0).astype(np.float32) / max(1, int(mask.sum()))
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = states.reshape(-1, 2 * self.hidden).T @ d.reshape(-1, 1)
        grads["bias"] = d.sum(keepdims=True).reshape(1)
        ds = d[:, :, None] * self.p["out"][:, 0]
        self._back("f", x, kf, ds[:, :, : self.hidden], grads)
        self._back("b", x[back, across], kb, ds[:, :, self.hidden :][back, across], grads)
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[list[int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED):
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        step, order = 0, sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        for _ in range(epochs):
            for g in r.permutation(len(groups)):
                some = [i for i in groups[g] if len(pages[i])]
                if not some:
                    continue
                x, lengths = self.padded([pages[i] for i in some])
                y = np.zeros(x.shape[:2], np.float32)
                for j, i in enumerate(some):
                    y[: lengths[j], j] = labels[i]
                step += 1
                for k, grad in self.gradients(x, lengths, y).items():
                    grad = np.clip(grad, -1, 1)
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


# FIXED VALUES: containers of the blocks put into training pages
FOREIGN = ["nav", "nav menu", "div menu", "div navbar", "header", "div header", "footer", "div footer", "aside", "aside sidebar", "div sidebar", "section sidebar",
           "div ad", "div ads", "div advertisement", "div banner", "div sponsored", "div promo", "div cookie notice", "div cookie consent", "div notice", "p notice", "div popup",
           "form", "form newsletter", "form search", "div subscribe", "div login", "section comments", "div comments", "div comment", "ol comment list", "ul comments", "li comment",
           "div respond", "div share", "div social", "ul share", "div related", "ul related", "div breadcrumb", "ul breadcrumbs", "div widget", "button", "select", "div copyright", "p copyright"]
FRAMES = [("article",), ("main",), ("main", "article"), ("article post",), ("div content", "article"), ("main", "div content"), ("article", "div story")]


# FIXED VALUES: containers and leaves of main text on composed pages, and containers of lists of links
SHELLS = [(), (), ("div",), ("div",), ("div", "div"), ("section",), ("article",), ("main",), ("main", "article"), ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("center", "table", "tr", "td")]
LEAVES = [("p",), ("p",), ("p",), ("h1",), ("h2",), ("h3",), ("ul", "li"), ("ul", "li", "p"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("pre",), ("dl", "dt"), ("dl", "dd"),
          ("figure", "figcaption"), ("table", "tr", "td"), ("table", "thead", "tr", "th"), ("table", "tbody", "tr", "td"), ("div",), ("div", "p"), ("section", "p"), ("section", "h2"), ()]
LINKS = [("ul", "li"), ("div",), ("p",), ("table", "tr", "td"), ("div", "ul", "li")]


def varied(page: list[Block], texts: list[str], r) -> tuple[list[Block], list[int]]:
    """The page in another frame with foreign blocks around and inside its main text, and its labels."""
    labels = taught(page)
    frame = FRAMES[int(r.integers(len(FRAMES)))] if r.random() < 0.5 else None
    out, marks = [], []

    def foreign(inside: tuple):
        kind = FOREIGN[int(r.integers(len(FOREIGN)))]
        path = inside + ((kind, ["p", "li", "div", "a"][int(r.integers(4))]) if r.random() < 0.6 else (kind,))
        for _ in range(int(r.integers(1, 5))):
            text = texts[int(r.integers(len(texts)))]
            words = text.split()
            at = int(r.integers(len(words)))
            text = " ".join(words[at : at + int(r.choice([1, 3, 12, 60]))])
            out.append(Block(path, text, len(text) if r.random() < 0.3 else 0))
            marks.append(0)

    for b, y in zip(page, labels, strict=True):
        path = b.path
        if frame:
            path = tuple(x for label in path for x in (frame if label.split()[0] == "article" else (label,)))
        if r.random() < 0.3:
            inside = path[:-1] if y else ("html", "body")
            foreign(inside)
        text = b.text
        if r.random() < 0.1:  # whatever the words are
            text = " ".join([text.split()[0]] * int(r.choice([1, 5, 30, 300])))
        out.append(Block(path, text, b.links))
        marks.append(y)
    return out, marks


def composed(texts: list[str], r) -> tuple[list[Block], list[int]]:
    """A page of a drawn layout with main text and foreign blocks of these texts, and its labels."""
    out, marks = [], []
    pick = lambda some: some[int(r.integers(len(some)))]
    body = ("html", "body") if r.random() < 0.8 else ()
    foreign_names = sorted(OTHER - {"title", "head"})

    def words(most):
        w = pick(texts).split()
        at = int(r.integers(len(w)))
        return " ".join(w[at : at + int(r.integers(1, most + 1))])

    def named(label):
        if r.random() < 0.5:
            return label
        made = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(int(r.integers(1, 3)))]
        return " ".join([label, *made, *([pick(sorted(MAIN))] if r.random() < 0.3 else [])])

    def add(path, text, label, link=0.0):
        out.append(Block(path, text, int(len(text) * link)))
        marks.append(label)

    def foreign(inside):
        if r.random() < 0.3:
            path = inside + tuple(named(x) for x in pick(LINKS))
            for _ in range(int(r.integers(2, 9))):
                add(path, words(5), 0, 1.0)
            return
        kind = pick(FOREIGN) if r.random() < 0.4 else f"{pick(['div', 'div', 'section', 'ul', 'p', 'span'])} {pick(foreign_names)}"
        path = inside + (kind,) + pick([(), ("p",), ("ul", "li"), ("div",), ("div", "p"), ("h3",)])
        link = pick([0.0, 0.0, 1.0])
        for _ in range(int(r.integers(1, 5))):
            add(path, words(60 if r.random() < 0.5 else 6), 0, link)

    shell = body + tuple(named(x) if x in ("div", "section", "article", "main", "td") else x for x in pick(SHELLS))
    around, within = pick([0, 2, 4]), pick([0.0, 0.1, 0.4])
    for _ in range(int(r.integers(around + 1))):
        foreign(body)
    # a layout has few kinds of leaves, and each comes in runs
    kinds = [tuple(named(x) if x == "div" and r.random() < 0.5 else x for x in pick(LEAVES)) for _ in range(int(r.integers(1, 6)))]
    for _ in range(int(r.integers(1, 8))):
        path = shell + pick(kinds)
        for _ in range(int(r.integers(1, 5))):
            add(path, words(60 if r.random() < 0.6 else 5), 1, pick([0.0, 0.0, 0.0, 0.2, 0.4]))
        if r.random() < within:
            foreign(shell)
    for _ in range(int(r.integers(around + 1))):
        foreign(body)
    return out, marks


def train(pages: DataFrame, html_col: str = "html", order_col: str = "url") -> Labeller:
    """Fit on a bounded sample; the same pages give the same labeller."""
    rows = pages.where(F.length(html_col).between(1, TRAIN_CHARS)).select(F.col(html_col).alias("html"), F.xxhash64(order_col, html_col).alias("h"))
    # hashes first, so that no task sends pages that are not chosen
    chosen = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]
    found = rows.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    sample = [blocks(r["html"]) for r in found]
    sample = [p for p in sample if p]
    model, r = Labeller(), np.random.default_rng(SEED)
    texts = [b.text for p in sample for b in p]
    if sample:
        made = [(p, taught(p)) for p in sample] + [varied(p, texts, r) for p in sample] + [composed(texts, r) for _ in range(3 * TRAIN_PAGES)]
        model.fit(vectors([p for p, _ in made]), [y for _, y in made])
    return model


def extracted(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for b in (p for whole in batches for p in pieces(whole, "html", 2 << 20)):
            read = [blocks(h or "") for h in b.column("html").to_pylist()]
            main = model.label(vectors(read))
            texts = ["\n".join(x.text for x, y in zip(p, m, strict=True) if y) for p, m in zip(read, main, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([len(p) for p in read], pa.int64()), pa.array([int(m.sum()) for m in main], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long, n_blocks long, n_main long")


def main_text(pages: DataFrame) -> DataFrame:
    return extracted(pages, train(pages))
