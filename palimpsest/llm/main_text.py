"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable: content or not.  Its own potential is
a logistic model of tag, names, text and links; parent and child share a potential.  The
graph is the DOM tree, so sum-product messages sent once upward and once downward give
exact marginals; blocks whose element is content with probability over one half are the
text.  Scripts, styles and other elements without page text never become blocks.

The model is fitted when first needed, on pages labelled by construction (`lesson`): a
documented, bounded sample of `TRAIN_PAGES` made-up pages over many layouts; nothing is
fitted on the pages that are extracted.

Defined results: a null or empty html gives an empty text; so does a page without
content; truncated and unclosed markup is read as far as it goes; a line break inside a
block is white space; repeated rows are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text
from palimpsest.llm.dom import FORM, Node, parse

SCHEMA = "page_id long, url string, text string, n_chars long"
TRAIN_PAGES, RIDGE = 500, 1.0

#: Words in class, id and role that speak against content, by kind, and for it.
AGAINST = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toolbar tabs toc skip",
    "frame": "header footer banner masthead copyright colophon site-info topbar bottom contentinfo",
    "side": "sidebar aside side rail widget related recommended complementary more trending popular tags archive",
    "advert": "ad ads advert advertisement adverts advertorial sponsor sponsored promo promotion adsense dfp outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription paywall warning banner-notice",
    "form": "form search login signup signin register contact-form input",
    "reader": "comment comments respond replies reply disqus discussion thread reader-comments feedback",
    "share": "share sharing social follow facebook twitter",
}
FOR = "article content post entry story main body text articlebody post-content entry-content article-body page-content".split()
_KIND = {w: k for k, words in AGAINST.items() for w in words.split()} | dict.fromkeys(FOR, "for")
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption address nav header footer aside details summary center dialog menu".split()
_SPLIT = re.compile(r"[^a-z0-9-]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^| )hidden=|aria-hidden=true")


def features(node: Node, words: str) -> list[str]:
    """Names of a node's binary features; words: its own text."""
    out = ["bias", "tag:form" if node.tag in FORM else f"tag:{node.tag}" if node.tag in TAGS else "tag:other"]
    if node.names:
        kinds = set()
        for w in _SPLIT.split(node.names):
            for part in (w, *w.split("-")):
                if part in _KIND:
                    kinds.add(_KIND[part])
        out += [f"name:{k}" for k in kinds]
        if kinds == {"for"}:
            out.append("only for, text" if node.chars else "only for")
        if HIDDEN.search(node.names):
            out.append("hidden")
    if node.chars:
        share = node.in_link / node.chars
        out.append("links:none" if share == 0 else "links:some" if share < 0.5 else "links:most")
        out.append(f"size:{min(5, int(math.log2(node.chars + 1) / 1.6))}")
        if "©" in words or "copyright" in words[:200].lower():
            out.append("copyright")
        if words.rstrip()[-1:] in ".!?:;\"'”»…":
            out.append("ends")
    else:
        out.append("no text")
    return out


ROOTS = frozenset(("#root", "html", "body"))
GROUPS = ("root", "speaks for", "speaks against", "wraps", "text")


def group(parent: Node) -> int:
    """Which potential an edge below this parent has."""
    if parent.tag in ROOTS:
        return 0
    kinds = {_KIND.get(p) for w in _SPLIT.split(parent.names) for p in (w, *w.split("-"))} - {None} if parent.names else set()
    if kinds - {"for"} or parent.tag in ("nav", "aside", "header", "footer") or parent.tag in FORM:
        return 2
    if "for" in kinds or parent.tag in ("article", "main"):
        return 1
    return 3 if parent.tag in ("div", "section", "center") else 4


class Model:
    """weights: log-odds of features; edges[g][p][x]: potential of child x below parent p."""

    def __init__(self, weights: dict[str, float], edges: list) -> None:
        self.weights, self.edges = weights, edges

    def marginals(self, nodes: list[Node], words: list[str]) -> list[float]:
        """Probability of content of each node; nodes come parents first."""
        weight = self.weights.get
        n = len(nodes)
        odds = [sum([weight(f, 0.0) for f in features(x, w)]) for x, w in zip(nodes, words, strict=True)]
        own = []
        for o in odds:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, o))))
            own.append((1 - p, p))
        kinds = [group(x) for x in nodes]
        up0, up1 = [x[0] for x in own], [x[1] for x in own]  # own potential times messages from children
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            j = nodes[i].parent
            (a, b), (c, d) = self.edges[kinds[j]]
            m0, m1 = a * up0[i] + b * up1[i], c * up0[i] + d * up1[i]
            t = m0 + m1
            sent[i] = m0, m1 = m0 / t, m1 / t
            x0, x1 = up0[j] * m0, up1[j] * m1
            t = x0 + x1
            up0[j], up1[j] = x0 / t, x1 / t
        b0, b1 = list(up0), list(up1)
        for i in range(1, n):
            j = nodes[i].parent
            (a, b), (c, d) = self.edges[kinds[j]]
            m0, m1 = sent[i]
            r0, r1 = b0[j] / max(m0, 1e-300), b1[j] / max(m1, 1e-300)
            x0, x1 = up0[i] * (r0 * a + r1 * c), up1[i] * (r0 * b + r1 * d)
            t = x0 + x1
            b0[i], b1[i] = x0 / t, x1 / t
        return [y / (x + y) for x, y in zip(b0, b1, strict=True)]


def _prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(("th", "er", "on", "an", "re", "ti", "es", "le", "qu", "ä", "ó", "st", "and")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(0, n, rng.randint(4, 14)):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += rng.choice((".", ".", ",", "!", "?"))
    return " ".join(words) + rng.choice((".", ".", ".", "", "?"))


def lesson(seed: int) -> str:
    """A made-up page; elements of content carry data-c="1", others data-c="0"."""
    rng = random.Random(seed)
    say = lambda lo, hi: _prose(rng, rng.randint(lo, hi))
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{say(1, 3)}</a>'
    pick = lambda kind: rng.choice(AGAINST[kind].split())

    def box(tag: str, names: str, inner: str, c: int) -> str:
        attribute = rng.choice(("class", "class", "class", "id"))
        return f'<{tag}{f" {attribute}={chr(34)}{names}{chr(34)}" if names else ""} data-c="{c}">{inner}</{tag}>'

    def items(n: int, c: int, make) -> str:
        return box(rng.choice(("ul", "ul", "ol")), "", "".join(f'<li data-c="{c}">{make()}{"</li>" if rng.random() < 0.8 else ""}' for _ in range(n)), c)

    def menu() -> str:
        inner = items(rng.randint(3, 8), 0, link) if rng.random() < 0.8 else rng.choice((" | ", " ", "")).join(link() for _ in range(5))
        return box("nav", rng.choice(("", pick("menu"))), inner, 0) if rng.random() < 0.6 else box("div", rng.choice((pick("menu"), pick("menu"), "")), inner, 0)

    def para() -> str:
        inner = say(1, 120) if rng.random() < 0.85 else f"{say(3, 30)} {link()} {say(3, 30)}"
        if rng.random() < 0.25:
            inner = f"<b>{inner}<br>"
        return f'<p data-c="1">{inner}{"</p>" if rng.random() < 0.8 else ""}'

    def bare() -> str:
        """Text that stands in its container without paragraphs."""
        head = f'<h1 data-c="1">{say(2, 10)}</h1>' if rng.random() < 0.5 else ""
        return head + rng.choice(("<br>", "<br><br>", " ")).join(say(8, 90) for _ in range(rng.randint(1, 5)))

    def content() -> str:
        if rng.random() < 0.15:
            return bare()
        out = [f'<h1 data-c="1">{say(2, 10)}</h1>'] if rng.random() < 0.75 else []
        if rng.random() < 0.2:
            out.insert(0, box("header", "", f'<h1 data-c="1">{say(2, 9)}</h1>', 1))
        for _ in range(rng.choice((0, 1, 1, 2, 4, 8, 12))):
            x = rng.random()
            if x < 0.75:
                out.append(para())
            elif x < 0.82:
                out.append(f'<{(h := rng.choice(("h2", "h3")))} data-c="1">{say(1, 7)}</{h}>')
            elif x < 0.88:
                out.append(items(rng.randint(2, 5), 1, lambda: say(2, 25)))
            elif x < 0.92:
                out.append(box("blockquote", "", para(), 1))
            elif x < 0.95:
                out.append(box("table", "", f'<tr data-c="1"><td data-c="1">{say(1, 9)}</td><td data-c="1">{say(1, 9)}</td></tr>', 1))
            elif x < 0.97:
                out.append(box("pre", "", say(5, 40), 1))
            else:
                out.append(rng.choice((advert, side, share))())
        if rng.random() < 0.15:
            out.append(rng.choice((reader, share, advert, side))())
        return "".join(out)

    def advert() -> str:
        return box(rng.choice(("div", "div", "aside", "section", "p")), pick("advert"), say(2, 25), 0)

    def side() -> str:
        inner = f'<h3 data-c="0">{say(1, 3)}</h3>' + (items(rng.randint(2, 6), 0, link) if rng.random() < 0.6 else f'<p data-c="0">{say(3, 30)}</p>')
        return box("aside", rng.choice(("", pick("side"))), inner, 0) if rng.random() < 0.5 else box("div", pick("side"), inner, 0)

    def notice() -> str:
        return box(rng.choice(("div", "section", "p", "dialog")), pick("notice"), f'<p data-c="0">{say(4, 30)}</p>' + rng.choice(("", '<button data-c="0">OK</button>')), 0)

    def form() -> str:
        return f'<form data-c="0"{rng.choice(("", " class=search"))}><label data-c="0">{say(1, 3)}</label><input name="q"><button data-c="0">{say(1, 2)}</button></form>'

    def reader() -> str:
        one = lambda: box(rng.choice(("div", "article", "li")), rng.choice(("comment", "reply", "")), f'<p data-c="0">{say(3, 50)}</p>', 0)
        return box(rng.choice(("section", "div", "ol", "ul")), pick("reader"), f'<h3 data-c="0">{say(1, 3)}</h3>' * (rng.random() < 0.5) + "".join(one() for _ in range(rng.randint(1, 5))), 0)

    def share() -> str:
        return box(rng.choice(("div", "ul")), pick("share"), " ".join(link() for _ in range(3)), 0)

    def head() -> str:
        inner = f'<p data-c="0">{say(1, 5)}</p>' + (menu() if rng.random() < 0.4 else "")
        return box("header", "", inner, 0) if rng.random() < 0.6 else box("div", rng.choice(("header", "masthead", "topbar", "banner")), inner, 0)

    def foot() -> str:
        inner = rng.choice((f"&copy; {say(1, 4)} &middot; {say(3, 14)}", f'<p data-c="0">{say(3, 20)}</p>', " ".join(link() for _ in range(4))))
        return box("footer", "", inner, 0) if rng.random() < 0.7 else box("div", rng.choice(("footer", "copyright", "site-info")), inner, 0)

    x = rng.random()
    body = content()
    if x < 0.5:
        body = box("article", rng.choice(("", "", "post", "entry")), body, 1)
    elif x < 0.7:
        body = box(rng.choice(("main", "div", "div", "section")), rng.choice(("content", "post-content", "entry", "article-body", "story", "main", "body")), body, 1)
    elif x < 0.85:
        body = box("main", "", box(rng.choice(("article", "div", "section")), "", body, 1), 1)
    else:
        body = box("div", "", body, 1)
    around = [f() for f in rng.sample((menu, advert, side, notice, form, share, head, menu), rng.choice((0, 1, 1, 2, 3, 4, 5)))]
    below = [f() for f in rng.sample((reader, foot, foot, side, advert, reader, notice), rng.choice((0, 1, 1, 2, 3)))]
    page = "".join(around) + body + "".join(below)
    if rng.random() < 0.3:
        page = box("div", rng.choice(("", "page", "wrapper", "container")), page, 1)
    return f'<!DOCTYPE html><html><head><title>{say(2, 6)}</title><style>p{{margin:0}}</style></head><body data-c="1">{page}</body></html>'


def _labelled(page: str) -> tuple[list[Node], list[str], list[int]]:
    nodes, blocks = parse(page)
    marks = [1 if m == "1" else 0 for m in re.findall(r'data-c="(\d)"', page)]
    labels, k = [], 0
    for x in nodes:
        if x.tag in ("#root", "html", "head", "title", "style"):
            labels.append(1)
        else:
            labels.append(marks[k])
            k += 1
    return nodes, texts_of(nodes, blocks), labels


def texts_of(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[str]:
    return [" ".join([blocks[b][1] for b in x.blocks]) if x.blocks else "" for x in nodes]


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES) -> Model:
    """Node weights and edge potentials together, by pseudo-likelihood: every variable given
    its neighbours' labels is a logistic regression, solved by Newton steps with a ridge
    penalty.  Each also counts once without its neighbours, so that node weights stand on
    their own where a block has few.  Deterministic."""
    rows, labels, ties = [], [], []
    for seed in range(pages):
        nodes, texts, marks = _labelled(lesson(seed))
        for i, (x, t) in enumerate(zip(nodes, texts, strict=True)):
            rows.append(features(x, t))
            labels.append(marks[i])
            ties.append(np.zeros((len(GROUPS), 2, 2)))
            if i:
                g, y = group(nodes[x.parent]), marks[x.parent]
                ties[-1][g, y] += -1, 1  # what label 1 adds over label 0 as a child,
                ties[x.parent - i - 1][g, :, marks[i]] += -1, 1  # and as the parent
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    ties = np.array(ties).reshape(len(rows), -1)
    x = np.vstack([np.hstack([x, ties]), np.hstack([x, 0 * ties])])  # with its neighbours, and alone
    y, w = np.array(labels + labels, float), np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - RIDGE * w
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
    edges = np.exp(w[len(names) :].reshape(len(GROUPS), 2, 2))
    return Model(dict(zip(names, w[: len(names)].tolist(), strict=True)), edges.tolist())


def extract(model: Model, page: str) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    content = model.marginals(nodes, texts_of(nodes, blocks))
    return "\n".join([text for node, text in blocks if content[node] > 0.5])


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars; pages: page_id, url, html."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            step = 256
            for a in range(0, len(column), step):
                texts = [extract(model, h) for h in column[a : a + step].to_pylist()]
                part = slice(a, a + len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("page_id")[part], batch.column("url")[part], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), as_text("html").alias("html")).mapInArrow(run, SCHEMA)
