"""Main text of HTML pages: gradient-boosted trees over DOM-node features with a hierarchical decoding.

Training pages come from the table itself: a bounded sample whose article is marked up as such (or else is the element with most
paragraph text). Each is also taken in other layouts, where regions get other tags and class names or none at all and other
regions (menus, side bars, notices, forms, reader comments) are added from other pages' text, and where the article's paragraphs become lists,
tables, quotes, captions, plain ``div`` or lines, so that the trees learn from density,
position and neighbours and not from the names alone. A decoding over the tree then keeps or drops: what stands in a dropped element is dropped.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import slices, with_fields
from worklens.llm.dom import INLINE, Page, read

#: Pages to learn from at most, and layouts of each.
TRAIN_PAGES = 150
LAYOUTS = 6
TREES, LEVELS, BINS, RATE = 50, 5, 32, 0.2

GOOD = ["article", "body", "content", "entry", "main", "page", "post", "story", "text"]
BAD = ["ad", "ads", "advert", "aside", "banner", "bar", "bottom", "breadcrumb", "comment", "comments", "cookie", "disqus", "footer", "form", "header", "links", "login", "menu",
       "meta", "nav", "navigation", "newsletter", "notice", "popup", "promo", "related", "replies", "search", "share", "sidebar", "signup", "social", "sponsor", "subscribe", "tags", "toolbar", "top", "widget"]
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "a", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "span"]
_WORDS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.!?,;](?:\s|$)")


def features(page: Page) -> np.ndarray:
    """One row for each element of ``page``."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 4))  # text, words, marks, text in links
    link = [False] * n
    for k in range(1, n):
        link[k] = page.tag[k] == "a" or link[page.parent[k]]
    for k, _, t in page.text:
        size = len(t.strip())
        if size:
            own[k] += (size, t.count(" ") + 1, len(_MARKS.findall(t)), size * link[k])
    tag = page.tag
    count = np.array([[1, t == "p", t in ("li", "a"), t in ("input", "button", "select", "textarea", "label")] for t in tag], float)
    total = np.concatenate([own, count], axis=1)
    direct = own.copy()  # with the text of inline children
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
        if tag[k] in INLINE:
            direct[parent[k]] += direct[k]
    before = np.concatenate(([0], np.cumsum(own[:-1, 0])))
    words = [set(_WORDS.findall(a)) for a in page.attrs]
    good = np.array([len(w.intersection(GOOD)) for w in words], float)
    bad = np.array([len(w.intersection(BAD)) for w in words], float)
    named = np.array([[t in ("article", "main"), t in ("nav", "aside", "footer", "header", "form")] for t in tag], float)
    marks = np.stack([good, bad, *named.T], axis=1)
    above = np.zeros_like(marks)
    siblings = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(1)
    nth, seen, alike = np.zeros(n), np.zeros(n), np.zeros(n)
    kinds: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        p = parent[k]
        above[k] = above[p] + marks[p]
        nth[k] = seen[p]
        seen[p] += 1
        kinds[p, tag[k]] = kinds.get((p, tag[k]), 0) + 1
    for k in range(1, n):
        alike[k] = kinds[parent[k], tag[k]]
    whole = max(1.0, total[0, 0])
    text, elements = total[:, 0], np.maximum(total[:, 4], 1)
    up = np.where(parent < 0, 0, parent)
    share = text / np.maximum(text[up], 1)
    base = np.stack(
        [text, total[:, 1], text / elements, total[:, 3] / np.maximum(text, 1), total[:, 2] / np.maximum(total[:, 1], 1), total[:, 5], total[:, 6], total[:, 7], text / whole,
         before / whole, direct[:, 0], direct[:, 3] / np.maximum(direct[:, 0], 1), direct[:, 2], total[:, 5] / elements, total[:, 6] / elements],
        axis=1,
    )
    places = np.stack([np.array(page.depth, float), siblings[up], nth, alike, share], axis=1)
    kind = np.array([[t == x for x in TAGS] for t in tag], float)
    return np.concatenate([base, base[up], places, marks, marks[up], above, kind], axis=1)


class Trees:
    """Boosted regression trees on the logistic loss, grown by level over quantile bins."""

    def __init__(self, edges: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, start: float):
        self.edges, self.feature, self.cut, self.value, self.start = edges, feature, cut, value, start

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, bins: int = BINS, rate: float = RATE) -> Trees:
        edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T if len(x) else np.zeros((x.shape[1], bins - 1))
        b = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        inner = 2**levels - 1
        feature, cut, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, 2**levels))
        mean = (y.sum() + 1) / (len(y) + 2)
        start = float(np.log(mean / (1 - mean)))
        z = np.full(len(x), start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(x), np.int64)
            for level in range(levels):
                nodes = 2**level
                gain, best = np.full(nodes, 1e-6), [(0, bins)] * nodes
                for f in range(x.shape[1]):
                    at = leaf * bins + b[:, f]
                    gs = np.cumsum(np.bincount(at, g, nodes * bins).reshape(nodes, bins), axis=1)
                    hs = np.cumsum(np.bincount(at, h, nodes * bins).reshape(nodes, bins), axis=1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    won = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    won = np.where((hl > 0.5) & (ht - hl > 0.5), won, 0)
                    k = won.argmax(axis=1)
                    for q in np.flatnonzero(won[np.arange(nodes), k] > gain):
                        gain[q], best[q] = won[q, k[q]], (f, int(k[q]))
                right = np.zeros(len(x), bool)
                for q, (f, k) in enumerate(best):
                    if k < bins:
                        feature[t, nodes - 1 + q], cut[t, nodes - 1 + q] = f, edges[f, k]
                        right |= (leaf == q) & (b[:, f] > k)
                leaf = 2 * leaf + right
            gs, hs = np.bincount(leaf, g, 2**levels), np.bincount(leaf, h, 2**levels)
            value[t] = rate * gs / (hs + 1)
            z += value[t][leaf]
        return Trees(edges, feature, cut, value, start)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        levels = int(np.log2(self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(levels):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += value[at - (2**levels - 1)]
        return z


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Elements to keep: the choice of the largest sum of log odds in which a dropped element keeps nothing inside it.
    Elements that are not judged add nothing of their own and stand and fall with their parent."""
    judged = elements(page)
    gain = np.where(judged, np.clip(logit, -8, 8), 0.0)
    gain[0] = 0
    for k in range(len(gain) - 1, 0, -1):
        if gain[k] > 0:
            gain[page.parent[k]] += gain[k]
    keep = gain > 0
    keep[0] = True
    for k in range(1, len(gain)):
        keep[k] = keep[page.parent[k]] and (keep[k] or not judged[k])
    return keep


def blocks(page: Page, keep: np.ndarray) -> str:
    """Text of the kept elements: white space in a block as one blank, blocks joined by line ends in page order."""
    out: list[str] = []
    run, last = [], -1
    for k, block, text in [*page.text, (0, -2, "")]:
        if block != last:
            if line := " ".join("".join(run).split()):
                out.append(line)
            run, last = [], block
        if keep[k]:
            run.append(text)
    return "\n".join(out)


def elements(page: Page) -> np.ndarray:
    """Elements that are judged: all but inline ones without a name of their own, which go with their parent."""
    return np.array([k == 0 or t not in INLINE or bool(a) for k, (t, a) in enumerate(zip(page.tag, page.attrs, strict=True))])


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees judge the elements of all of them at once."""
    pages = [read(s or "") for s in sources]
    logit = trees.logit(np.concatenate([features(p) for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for page in pages:
        own = logit[at : at + len(page.tag)]
        at += len(page.tag)
        out.append(blocks(page, decode(page, own)))
    return out


_REGION = re.compile(r"<(/?)(nav|footer|aside|header|form|article|main)\b([^>]*)>|<div class=\"ad\">(.*?)</div>", re.S | re.I)


_ARTICLE = re.compile(r"(<(article|main)\b[^>]*>)(.*?)(</\2>)", re.S | re.I)
_PARAGRAPH = re.compile(r"<p>([^<]+)</p>")


def reshaped(source: str, rng: random.Random) -> str:
    """``source`` with the same article text in other elements: some paragraphs as lists, tables, quotes, captions or behind sub-heads, or all
    of them as ``div`` or parted by line breaks."""

    def parts(text: str, low: int, high: int) -> list[str]:
        w = text.split()
        size = max(1, len(w) // rng.randint(low, high))
        return [" ".join(w[k : k + size]) for k in range(0, len(w), size)]

    def form(m: re.Match) -> str:
        text, kind = m[1], rng.randrange(13)
        first, rest = " ".join(text.split()[:4]), " ".join(text.split()[4:]) or text
        if kind < 2:
            tag = ("ul", "ol")[kind]
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in parts(text, 2, 6)) + f"</{tag}>"
        if kind == 2:
            return "<table>" + "".join(f"<tr><td>{x}</td><td>{first}</td></tr>" for x in parts(text, 2, 8)) + "</table>"
        if kind == 3:
            return "<dl>" + "".join(f"<dt>{first}</dt><dd>{x}</dd>" for x in parts(text, 1, 4)) + "</dl>"
        if kind == 4:
            return f'<figure><img src="i.png"><figcaption>{" ".join(text.split()[: rng.randint(4, 20)])}</figcaption></figure><p>{rest}</p>'
        if kind == 5:
            tag = rng.choice(["h2", "h3", "h4"])
            return f"<{tag}>{first}</{tag}><p>{rest}</p>"
        if kind < 9:
            tag = ("blockquote", "pre", "div")[kind - 6]
            return f"<{tag}>{text}</{tag}>"
        if kind == 9:
            return f'<p><a href="/a">{text}</a></p>'
        if kind == 10:
            return "<blockquote>" + "".join(f"<p>{x}</p>" for x in parts(text, 1, 2)) + "</blockquote>"
        tag = ("div", "section")[kind - 11]
        return f"<{tag}>" + f"<h3>{first}</h3>" * rng.randint(0, 1) + f"<p>{text}</p></{tag}>"

    def inside(m: re.Match) -> str:
        mode, body = rng.random(), m[3]
        if mode < 0.45:
            body = _PARAGRAPH.sub(lambda p: form(p) if rng.random() < 0.4 else p[0], body)
        elif mode < 0.6:
            body = _PARAGRAPH.sub(r"<div>\1</div>", body)
        elif mode < 0.7:
            body = _PARAGRAPH.sub(r"\1<br><br>", body)
        return m[1] + body + m[4]

    return _ARTICLE.sub(inside, source)


def layouts(sources: list[str], variants: int = LAYOUTS) -> list[str]:
    """Pages with ``data-y`` marks on their regions: each source as it stands, and in other layouts."""
    rng = random.Random(11)
    made = []
    prose = [re.findall(r"<p>([^<]{20,400})", s) or ["Read on."] for s in sources]

    def some(low: int, high: int) -> list[str]:
        texts = rng.choice(prose)
        return [rng.choice(texts) for _ in range(rng.randint(low, high))]

    def words(n: int) -> str:
        return " ".join(rng.choice(rng.choice(prose)).split()[:n])

    def extra() -> str:
        kind = rng.randrange(7)
        items = "".join(f'<li><a href="/{k}">{words(rng.randint(1, 6))}</a></li>' for k in range(rng.randint(3, 9)))
        name = rng.choice
        if kind == 0:  # reader comments
            box = name(['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<section id="replies">', '<div class="disqus">', "<div>", "<section>", "<div>"])
            one = "<div>" if "=" not in box else f'<div class="{name(["comment", "reply", "comment-body"])}">'
            body = "".join(one + f"<b>{words(2)}</b>" * rng.randint(0, 1) + "".join(f"<p>{t}</p>" for t in some(1, 2)) + "</div>" for _ in range(rng.randint(1, 5)))
            body = f"<h3>{words(2)}</h3>" * rng.randint(0, 1) + body
        elif kind == 1:
            box, body = name(["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">']), f"<h3>{words(2)}</h3><ul>{items}</ul>"
        elif kind == 2:
            box = name(['<div class="cookie-notice">', '<div class="notice">', '<div id="cookie-banner">', '<div role="alert" class="popup">', '<p class="notice">'])
            body = f"{rng.choice(some(1, 1))}" + "<button>OK</button>" * rng.randint(0, 1)
        elif kind == 3:
            box, body = name(["<form>", '<form class="newsletter">', '<div class="signup"><form>']), f'<label>{words(3)}</label><input type="text"><p>{words(12)}</p><button>{words(1)}</button>'
        elif kind == 4:
            box, body = name(["<header>", '<div class="header">', '<div id="top">']), f'<a href="/">{words(3)}</a>' + f"<p>{words(8)}</p>" * rng.randint(0, 1)
        elif kind == 5:
            box, body = name(['<div class="promo">', '<div class="advert">', '<div class="sponsor">', "<aside>", '<div class="ad">', '<div class="banner-ad">']), "".join(f"<p>{t}</p>" for t in some(1, 2)) if rng.random() < 0.5 else rng.choice(some(1, 1))
        else:
            box, body = name(['<div class="menu">', "<nav>", '<ul class="nav">', '<div id="navigation">', '<div class="breadcrumb">', '<div class="share">', '<div class="tags">']), f"<ul>{items}</ul>"
        opened = re.findall(r"<(\w+)", box)
        return box.replace(">", ' data-y="0">', 1) + body + "".join(f"</{t}>" for t in reversed(opened))

    for s in sources:
        for v in range(variants):
            swap = {}
            if v:
                swap = {
                    "article": rng.choice(['<article class="post">', "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<div class="entry">', "<div>", '<section class="story">', "<section>", '<div role="main">']),
                    "nav": rng.choice(["<nav>", '<div class="menu">', '<div id="navigation">', "<div>", "<header>"]),
                    "footer": rng.choice(["<footer>", '<div class="footer">', '<div id="bottom">', "<div>"]),
                    "ad": rng.choice(['<div class="ad">', "<aside>", '<div class="promo">', '<div class="notice">', '<div class="sidebar">']),
                }
                swap["main"] = swap["article"]

            def mark(m: re.Match, swap=swap, v=v) -> str:
                if m[4] is not None:
                    box = swap.get("ad", '<div class="ad">')
                    return box.replace(">", ' data-y="0">', 1) + m[4] + f"</{re.match(r'<(\w+)', box)[1]}>"
                name = m[2].lower()
                y = int(name in ("article", "main"))
                box = swap.get(name)
                if m[1]:
                    end = f"</{re.match(r'<(\w+)', box)[1]}>" if box else m[0]
                    return end + "".join(extra() for _ in range(rng.randint(0, 2))) if y and v else end
                box = box or f"<{m[2]}{m[3]}>"
                lead = "".join(extra() for _ in range(rng.randint(0, 2))) if y and v else ""
                return lead + box.replace(">", f' data-y="{y}">', 1)

            page = _REGION.sub(mark, reshaped(s, rng) if v else s)
            if v and rng.random() < 0.5:
                page = re.sub(r"(<body[^>]*>)(.*?)(</body>|\Z)", rf'\1<div class="{rng.choice(["wrapper", "container", "page", "site"])}">\2</div>\3', page, count=1, flags=re.S)
            if v and rng.random() < 0.4:  # menus and notices also stand inside articles
                spots = [m.end() for m in re.finditer(r"</p>", page)]
                if spots:
                    at = rng.choice(spots)
                    page = page[:at] + extra() + page[at:]
            made.append(page)
    return made


def examples(sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the judged elements: 1 if most text inside belongs to the article."""
    xs, ys = [], []
    for source in layouts(sources):
        page = read(source)
        state = np.full(len(page.tag), -1)
        for k, a in enumerate(page.attrs):
            p = page.parent[k]
            if "data-y" in a:
                state[k] = int(a[a.index("data-y") + 6] == "1") and (p < 0 or state[p] != 0)
                page.attrs[k] = a.replace("data-y0", "").replace("data-y1", "").strip()
            elif p >= 0:
                state[k] = state[p]
        if not (state == 1).any():
            paragraphs = np.zeros(len(page.tag))
            for k, _, t in page.text:
                up = k
                while up and page.tag[up] != "p":
                    up = page.parent[up]
                if up and state[up] < 0:
                    paragraphs[page.parent[up]] += len(t)
            best = int(paragraphs.argmax())
            for k in range(best, len(state)):
                if k == best and paragraphs[best] or k > best and state[page.parent[k]] == 1 and state[k] < 0:
                    state[k] = 1
        text = np.zeros((len(page.tag), 2))
        for k, _, t in page.text:
            text[k] += (len(t.strip()), len(t.strip()) * (state[k] == 1))
        for k in range(len(text) - 1, 0, -1):
            text[page.parent[k]] += text[k]
        use = elements(page) & (text[:, 0] > 0)
        use[0] = False
        xs.append(features(page)[use])
        ys.append((text[use, 1] * 2 > text[use, 0]).astype(float))
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> Trees:
    """Trees learned in one task from a sample of ``rows`` pages at most, in the order of a hash; only the trees come back.
    Without pages they keep nothing."""
    sample = pages.select(F.col("html").cast("string").alias("html")).where("html IS NOT NULL").orderBy(F.xxhash64("html"), "html").limit(rows).repartition(1).sortWithinPartitions(F.xxhash64("html"), "html")

    def learn(batches):
        sources = [s for b in batches for s in b.column("html").to_pylist()]
        if not sources:
            return
        x, y = examples(sources)
        t = Trees.fit(x, y)
        parts = [t.edges, t.feature, t.cut, t.value, np.array([t.start])]
        yield pa.RecordBatch.from_arrays([pa.array([p.astype(float).tobytes() for p in parts]), pa.array([list(p.shape) for p in parts], pa.list_(pa.int32()))], ["data", "shape"])

    got = sample.mapInArrow(learn, "data binary, shape array<int>").toArrow()
    if not len(got):
        return Trees(np.zeros((1, 1)), np.zeros((0, 1), np.int32), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    parts = [np.frombuffer(d).reshape(s) for d, s in zip(got["data"].to_pylist(), got["shape"].to_pylist(), strict=True)]
    return Trees(parts[0], parts[1].astype(np.int32), parts[2], parts[3], float(parts[4][0]))


def extract_pages(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``; a null or empty html gives an empty text, repeated rows repeat,
    markup that never ends is read to its end, and an empty table gives no rows."""
    model = pages.sparkSession.sparkContext.broadcast(trees)
    base = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = with_fields(base.drop("html"), "text string, n_chars long")

    def run(batches):
        for b in batches:
            for at, rows in slices(b.column("html")):
                part = b.slice(at, rows)
                text = extract(part.column("html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], schema.names)

    return base.mapInArrow(run, schema)
