"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Every block-level node has features of itself and of its subtree: text density, share of linked text,
punctuation, attribute tokens of itself and its ancestors (hashed), element kind, depth, and how it
stands among its siblings. Boosted trees give each node the log-odds of belonging to the article.
Nodes are then decided together: a node can be kept only if its parent is, and of all such choices the
one with the largest sum of log-odds is found in one walk from the leaves, so no kept paragraph hangs
under a dropped menu.

There are no labelled pages, so the trees learn from two sources, both made from at most ``PAGES``
pages chosen by a hash of their id. Pages that use HTML's own elements label themselves (what is inside
article or main, and not inside nav, aside, form, footer, …). And article text of such pages is set anew
in drawn layouts of plain divs with menus, bars, adverts, notices, forms and comments, whose labels are
known; there, elements and attributes are often nondescript, which makes the trees use structure.

A null or empty page, and one without article text, gives an empty text. Very long pages are read
whole. Null ids and urls and repeated rows pass through; extra columns too, but for those that have the
name of a result. Without any page that labels itself, drawn layouts around the page's longest text are
all there is to learn from; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm import boosting
from fleetfold.llm.common import stored, wide_enough
from fleetfold.llm.dom import Node, read, text_of

PAGES, NODES, LAYOUTS = 500, 60, 3  # pages to learn from, nodes of each, drawn layouts of each
HASHED = 32
# Element kinds, and tokens by which pages name their furniture.
KINDS = {
    k: i
    for i, names in enumerate(
        ["p blockquote pre", "h1", "h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "div", "section", "article main", "nav", "header",
         "footer", "aside", "form fieldset", "table tbody tr td th", "document html body", "figure figcaption"]
    )
    for k in names.split()
}
SKIPPED = frozenset("nav header footer aside form menu dialog".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form "
    "header login menu modal nav navbar navigation newsletter notice notices pagination popup promo related reply respond share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
PLAIN = 19  # features that are no hash buckets
WIDTH = PLAIN + len(set(KINDS.values())) + 2 + 2 * HASHED


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % HASHED


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row per node. Children come after their parents, so one backward walk sums up subtrees."""
    n = len(nodes)
    text, linked, words, stops, controls, below = (
        [x.own for x in nodes], [x.linked for x in nodes], [x.words for x in nodes], [x.stops for x in nodes], [x.controls for x in nodes], [1] * n,
    )
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        linked[p] += linked[i]
        words[p] += words[i]
        stops[p] += stops[i]
        controls[p] += controls[i]
        below[p] += below[i]
    place, before, after, same = [0.0] * n, [0] * n, [0] * n, [0.0] * n
    bad, inherited = [0] * n, [frozenset()] * n
    start, x = [0] * n, np.zeros((n, WIDTH), dtype=np.float32)
    for i, node in enumerate(nodes):
        inside = start[i] + node.own
        kids = node.children
        for k, child in enumerate(kids):
            place[child] = k / len(kids)
            before[child] = text[kids[k - 1]] if k else 0
            after[child] = text[kids[k + 1]] if k + 1 < len(kids) else 0
            start[child] = inside
            inside += text[child]
        if len(kids) > 1:
            tags: dict[str, int] = {}
            for child in kids:
                tags[nodes[child].tag] = tags.get(nodes[child].tag, 0) + 1
            for child in kids:
                same[child] = tags[nodes[child].tag] / len(kids)
        own = [_bucket(t) for t in node.tokens]
        named = node.tag in SKIPPED or not FURNITURE.isdisjoint(node.tokens)
        if i:
            bad[i] = bad[node.parent] + named
            inherited[i] = inherited[node.parent] | frozenset(own) if own else inherited[node.parent]
        at = PLAIN + KINDS.get(node.tag, len(set(KINDS.values())))
        x[i, at] = 1
        x[i, PLAIN + len(set(KINDS.values())) + 1] = named
        base = PLAIN + len(set(KINDS.values())) + 2
        for b in own:
            x[i, base + b] = 1
        for b in inherited[i]:
            x[i, base + HASHED + b] = 1
    t, w = np.array(text, float), np.array(words, float)
    parent = np.array([max(0, node.parent) for node in nodes])
    x[:, :PLAIN] = np.stack(
        [
            np.log1p(t), np.log1p([v.own for v in nodes]), np.array(linked) / (t + 1), np.log1p(w), np.array(stops) / (w + 1),
            np.log1p(below), np.log1p(t / np.array(below)), [v.depth for v in nodes], place, np.log1p([len(nodes[p].children) for p in parent]),
            t / (t[parent] + 1), np.log1p(before), np.log1p(after), same, t / (w + 1), np.array(start) / (t[0] + 1),
            np.log1p(controls), t / (t[0] + 1), bad,
        ],
        axis=1,
    )
    return x


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The consistent choice with the largest sum of log-odds: kept nodes form a tree from the root."""
    value = np.clip(odds, -6, 6).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if value[i] > 0:
            value[nodes[i].parent] += value[i]
    kept = [False] * len(nodes)
    kept[0] = value[0] > 0
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and value[i] > 0
    return kept


def _labels_itself(nodes: list[Node]) -> list[int] | None:
    """1 for article nodes and what holds them, 0 for the rest; None if the page does not say."""
    if not any(v.tag in ("article", "main") for v in nodes):
        return None
    y, state = [0] * len(nodes), [0] * len(nodes)  # state: 0 outside, 1 inside an article, 2 in furniture
    for i, v in enumerate(nodes):
        above = state[v.parent] if i else 0
        furniture = v.tag in SKIPPED or not FURNITURE.isdisjoint(v.tokens)
        state[i] = 2 if above == 2 or furniture else 1 if above == 1 or v.tag in ("article", "main") else 0
        y[i] = int(state[i] == 1)
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] |= y[i]
    return y


class Layouts:
    """Pages drawn around given paragraphs; data-keep says what belongs to the article."""

    def __init__(self, seed: int, paragraphs: list[str], phrases: list[str]):
        self.draw, self.paragraphs, self.phrases = random.Random(seed), paragraphs, phrases or ["menu"]

    def named(self, tag: str, names: str, inner: str, keep: int) -> str:
        """An element of that kind, or a div, whose class, id or role tells its purpose or tells nothing."""
        how = self.draw.random()
        name = self.draw.choice(names.split())
        if how < 0.3:
            return f'<{tag} data-keep="{keep}">{inner}</{tag}>'
        if how < 0.75:
            element, attribute = self.draw.choice([tag, "div"]), self.draw.choice(["class", "id", "class"])
            return f'<{element} {attribute}="{name}" data-keep="{keep}">{inner}</{element}>'
        nothing = self.draw.choice(["", f' class="c{self.draw.randrange(99)}"', ' class="row"', ' class="col block"'])
        return f'<div{nothing} data-keep="{keep}">{inner}</div>'

    def phrase(self, most: int) -> str:
        words = self.draw.choice(self.phrases).split() or ["menu"]
        at = self.draw.randrange(len(words))
        return escape(" ".join(words[at : at + self.draw.randint(1, most)]))

    def links(self) -> str:
        item = lambda: f'<li data-keep="0"><a href="#">{self.phrase(4)}</a></li>'
        return f'<ul data-keep="0">{"".join(item() for _ in range(self.draw.randint(3, 9)))}</ul>'

    def said(self, most: int = 3) -> str:
        return "".join(f'<p data-keep="0">{self.phrase(40)}</p>' for _ in range(self.draw.randint(1, most)))

    def furniture(self) -> str:
        kinds = {
            "nav": ("nav", "menu navbar main-nav topnav breadcrumb", self.links),
            "header": ("header", "header site-header masthead top-bar", lambda: f'<h2 data-keep="0">{self.phrase(4)}</h2>' + self.said(1)),
            "footer": ("footer", "footer site-footer copyright bottom", lambda: f"&copy; {self.phrase(12)}" + self.links()),
            "aside": ("aside", "sidebar side right-col widget related", lambda: f'<h3 data-keep="0">{self.phrase(5)}</h3>' + self.draw.choice([self.links, self.said])()),
            "ad": ("div", "ad ads advert sponsored banner promo", lambda: self.draw.choice([self.phrase(25), self.said(1)])),
            "notice": ("div", "notice cookie-notice alert consent popup", lambda: self.phrase(30) + "<button>OK</button>"),
            "form": ("form", "form newsletter login search subscribe", lambda: f'<label>{self.phrase(6)}</label><input name="q"><button>Go</button>' + self.said(1)),
            "share": ("div", "share social toolbar tags", lambda: " ".join(f'<a href="#">{self.phrase(2)}</a>' for _ in range(4))),
            "comments": ("section", "comments comment-list disqus replies respond",
                         lambda: f'<h3 data-keep="0">{self.phrase(3)}</h3>' + "".join(f'<div class="comment" data-keep="0"><b>{self.phrase(2)}</b>{self.said(2)}</div>' for _ in range(self.draw.randint(1, 5)))),
        }
        tag, names, inner = kinds[self.draw.choice(list(kinds))]
        return self.named(tag, names, inner(), 0)

    def article(self) -> str:
        out = [f'<h1 data-keep="1">{escape(self.paragraphs[0][:80])}</h1>'] if self.draw.random() < 0.8 else []
        for text in self.paragraphs:
            kind = self.draw.random()
            body = escape(text)
            if kind < 0.06:
                body = f'<ul data-keep="1"><li data-keep="1">{body}</li></ul>'
            elif kind < 0.1:
                body = f'<blockquote data-keep="1">{body}</blockquote>'
            elif kind < 0.15:
                body = f'<h2 data-keep="1">{escape(text[:50])}</h2><p data-keep="1">{body}</p>'
            elif kind < 0.2:
                body = f'<div data-keep="1">{body}</div>'
            else:
                body = f'<p data-keep="1">{body}</p>'
            out.append(body)
            if self.draw.random() < 0.08:
                out.append(self.furniture())
        return self.named(self.draw.choice(["article", "main", "section"]), "content post article-body entry story main text", "".join(out), 1)

    def page(self) -> str:
        around = lambda: "".join(self.furniture() for _ in range(self.draw.randint(1, 4)))
        body = around() + self.article() + around()
        for _ in range(self.draw.randrange(3)):
            body = self.named("section", "wrapper container page inner", body, 1)
        return f'<html data-keep="1"><head><title>{self.phrase(6)}</title></head><body data-keep="1">{body}</body></html>'


def _examples(page: str, seed: int) -> list[tuple[list[Node], list[int]]]:
    nodes, pieces = read(page)
    own = _labels_itself(nodes)
    out = [] if own is None else [(nodes, own)]
    kept = [bool(v) for v in own] if own else [True] * len(nodes)
    parts: dict[int, list[str]] = {}
    rest: list[str] = []
    for piece in pieces:
        if piece is not None and piece[1].strip():
            if kept[piece[0]]:
                parts.setdefault(piece[0], []).append(piece[1])
            else:
                rest.append(piece[1])
    paragraphs = [" ".join("".join(p).split()) for p in parts.values()]
    if own is None:
        paragraphs = [p for p in paragraphs if len(p.split()) >= 20]
    if paragraphs:
        for k in range(LAYOUTS):
            drawn, _ = read(Layouts(seed * LAYOUTS + k, paragraphs[:40], rest + paragraphs).page())
            drawn[0].mark = "1"
            out.append((drawn, [int(v.mark == "1") for v in drawn]))
    return out


def training_nodes(pages: DataFrame, size: int = PAGES) -> DataFrame:
    """(x, y) of at most ``NODES`` nodes of each page learned from and each layout drawn from it."""
    share = size / max(size, pages.count())
    mark = F.pmod(F.xxhash64("page_id", F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(str(page_id).encode())
                for nodes, labels in _examples(page or "", seed):
                    chosen = random.Random(seed).sample(range(len(nodes)), min(NODES, len(nodes)))
                    features = node_features(nodes)
                    x += [features[i].tobytes() for i in chosen]
                    y += [labels[i] for i in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32())], names=["x", "y"])

    return pages.filter(mark < share).select("page_id", "html").mapInArrow(run, "x BINARY, y INT")


def train(pages: DataFrame, size: int = PAGES) -> dict | None:
    """The trees, fitted in one task: at most size * (1 + LAYOUTS) * NODES rows, whatever the table."""
    shape = "features ARRAY<LONG>, cuts ARRAY<DOUBLE>, leaves ARRAY<DOUBLE>, tree INT"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), WIDTH)
        order = np.lexsort([*x.T[:8], rows["y"]])
        model = boosting.train(x[order].astype(float), rows["y"].to_numpy()[order].astype(float))
        return pd.DataFrame({k: [v.tolist() for v in model[k]] for k in ("features", "cuts", "leaves")} | {"tree": range(len(model["leaves"]))})

    rows = stored(training_nodes(pages, size).groupBy().applyInPandas(fit, shape), "trees").orderBy("tree").toPandas()
    return {k: np.stack([np.array(v) for v in rows[k]]) for k in ("features", "cuts", "leaves")} if len(rows) else None


def extract(pages: DataFrame, size: int = PAGES) -> DataFrame:
    """Add text and n_chars (its code points) to every page."""
    model = train(pages.select("page_id", "html"), size)

    def texts(batch: list[str | None]) -> list[str]:
        parsed = [read(page) if page else ([], []) for page in batch]
        features = [node_features(nodes) for nodes, _ in parsed if nodes]
        odds = boosting.log_odds(model, np.concatenate(features)) if features and model else np.zeros(sum(len(n) for n, _ in parsed))
        out, at = [], 0
        for nodes, pieces in parsed:
            kept = decode(nodes, odds[at : at + len(nodes)]) if nodes else []
            at += len(nodes)
            out.append(text_of(pieces, kept))
        return out

    @F.pandas_udf("string")
    def main_text(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in html:
            values = series.tolist()
            yield pd.Series([t for i in range(0, len(values), 200) for t in texts(values[i : i + 200])], dtype=object)

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    done = wide_enough(pages.select(*kept)).withColumn("text", main_text("html"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
