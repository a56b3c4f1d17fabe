"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks. Each block becomes a vector: learned vectors of its hashed tag path and of its hashed words, and a
few measures. A bidirectional LSTM in numpy reads the sequence both ways, so each block is classified with the whole
page in view; what it takes for content is the text.

There are no labelled pages, so training makes its own from a bounded sample of the table, in one task: elements that say what they are
(article, main, nav, footer, aside, form, adverts, comments, ...) give the labels, and each sampled page is also rebuilt with other
containers and with boilerplate of other kinds around and inside the article, so that the labeller knows more layouts than the sample
has. Sampled pages are learned from as a whole; long ones as windows that follow one another.

Null or empty html, and pages without content, give an empty text. Very long pages are read as a whole. Rows that repeat are read each; null
page_id or url are kept as they are. A probability of exactly one half is content. An empty table gives no rows. Further columns are
ignored. Without any page to learn from, the rules that give the labels decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD, chunks, flat, gathered, hash_ranges, word_ranges
from .html_blocks import PATHS, Block, blocks, hashed

WORDS, PATH_DIM, WORD_DIM, HIDDEN, MEASURES = 1 << 12, 16, 8, 20, 6
IN = PATH_DIM + WORD_DIM + MEASURES
#: Blocks of a window that a long page is learned from.
WINDOW = 300
#: Parts of a path that mark what isn't the article, wherever they stand, and those that mark the article.
BAD = "nav menu navbar breadcrumb breadcrumbs footer aside sidebar form button dialog ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice notification alert newsletter subscribe subscription signup login related recommended share sharing social comment comments respond reply replies disqus discussion widget toolbar masthead popup modal hidden pagination pager tags skip contentinfo navigation complementary search copyright legal".split()
GOOD = "article main content post entry story body articlebody text".split()


def is_content(names: tuple[str, ...]) -> bool:
    """The label that a path's own words give; a page's header isn't content, a header inside the article is."""
    words = [n[2:] for n in names]
    bad = set(BAD)
    if any(w in bad for w in words) or "select" in words:
        return False
    good = [i for i, w in enumerate(words) if w in GOOD]
    if not good:
        return False
    head = [i for i, w in enumerate(words) if w == "header"]
    return not head or good[0] < head[0]


@dataclass
class Labeller:
    """All weights, by name."""

    w: dict[str, np.ndarray]

    def inputs(self, pages: list[list[Block]]) -> tuple[np.ndarray, tuple]:
        """Block vectors of all pages in a row, and what they were made from."""
        every = [b for p in pages for b in p]
        paths = np.array([i for b in every for i in b.path], np.int64)
        n_path = np.array([len(b.path) for b in every])
        buf, offsets = flat(pa.array([b.text for b in every], pa.string()))
        buf = LOWER[buf]
        starts, lengths, first = word_ranges(buf, offsets, WORD)
        words = (hash_ranges(buf, starts, lengths) >> np.uint64(52)).astype(np.int64)
        n_word = np.diff(first)
        chars = np.array([len(b.text) for b in every], float)
        stops = np.array([sum(map(b.text.count, ".!?")) for b in every], float)
        measures = np.stack([np.log1p(chars) / 6, np.log1p(n_word) / 4, [b.linked for b in every], stops / np.maximum(n_word, 1), chars < 40, np.array([b.text[-1:] in ".!?\"'" for b in every])], 1)
        x = np.zeros((len(every), IN))
        x[:, :PATH_DIM] = np.add.reduceat(self.w["paths"][paths], np.cumsum(n_path) - n_path, axis=0)
        run = np.concatenate([np.zeros((1, WORD_DIM)), np.cumsum(self.w["words"][words], axis=0)])
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = (run[first[1:]] - run[first[:-1]]) / np.maximum(n_word, 1)[:, None]
        x[:, PATH_DIM + WORD_DIM :] = measures
        return x, (paths, n_path, words, n_word)

    @staticmethod
    def grid(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Time x page x vector, and the flat place of each cell (-1: none)."""
        at = np.full((int(sizes.max()), len(sizes)), -1, np.int64)
        ends = np.cumsum(sizes)
        for j, (n, e) in enumerate(zip(sizes.tolist(), ends.tolist())):
            at[:n, j] = np.arange(e - n, e)
        return np.where((at >= 0)[:, :, None], x[at], 0), at

    def walk(self, x: np.ndarray, live: np.ndarray, way: str) -> list[tuple]:
        """States of one direction, step by step; padded steps leave the state as it is."""
        u, v, b = (self.w[f"{way}_{k}"] for k in "uvb")
        h = c = np.zeros((x.shape[1], HIDDEN))
        z_in = x @ u + b
        steps = []
        for t in range(len(x)) if way == "fore" else range(len(x) - 1, -1, -1):
            z = z_in[t] + h @ v
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = live[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            h_new = np.where(m, o * np.tanh(c_new), h)
            steps.append((t, h, c, i, f, o, g, c_new, h_new))
            h, c = h_new, c_new
        return steps

    def outputs(self, grid: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list, list]:
        fore, back = self.walk(grid, live, "fore"), self.walk(grid, live, "back")
        h = np.zeros((*live.shape, 2 * HIDDEN))
        for s in fore:
            h[s[0], :, :HIDDEN] = s[-1]
        for s in back:
            h[s[0], :, HIDDEN:] = s[-1]
        return h, fore, back

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """How likely each block is content. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and high - low < 64 and len(pages[order[high]]) * (high - low + 1) < 20_000:
                high += 1
            some = [pages[i] for i in order[low:high]]
            x, _ = self.inputs(some)
            grid, at = self.grid(x, np.array([len(p) for p in some]))
            h, _, _ = self.outputs(grid, at >= 0)
            p = 1 / (1 + np.exp(-(h @ self.w["out"] + grid @ self.w["skip"] + self.w["bias"])))
            for j, i in enumerate(order[low:high]):
                out[i] = p[: len(pages[i]), j]
            low = high
        return out


def fresh(rng: np.random.Generator) -> Labeller:
    w = {"paths": rng.normal(0, 0.1, (PATHS, PATH_DIM)), "words": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "skip": np.zeros(IN), "bias": np.zeros(1)}
    for way in ("fore", "back"):
        w |= {f"{way}_u": rng.normal(0, 0.25, (IN, 4 * HIDDEN)), f"{way}_v": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"{way}_b": np.zeros(4 * HIDDEN)}
        w[f"{way}_b"][HIDDEN : 2 * HIDDEN] = 1
    return Labeller(w)


def fit(pages: list[list[Block]], labels: list[np.ndarray], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Labeller:
    """Adam on the cross-entropy of all blocks; part of each path is hidden at random, so that neighbours and words must help."""
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        order = order[np.argsort(np.array([len(pages[i]) for i in order]) // 8, kind="stable")]
        runs = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in rng.permutation(len(runs)):
            run = runs[k]
            some = [[b._replace(path=tuple(x for x in b.path if rng.random() > 0.15) or b.path[:1]) for b in pages[i]] for i in run]
            x, (paths, n_path, words, n_word) = net.inputs(some)
            sizes = np.array([len(p) for p in some])
            grid, at = net.grid(x, sizes)
            live = at >= 0
            y = np.where(live, np.concatenate([labels[i] for i in run])[at], 0)
            h, fore, back = net.outputs(grid, live)
            p = 1 / (1 + np.exp(-(h @ net.w["out"] + grid @ net.w["skip"] + net.w["bias"])))
            d = np.where(live, p - y, 0) / live.sum()
            g = {k: np.zeros_like(v) for k, v in net.w.items()}
            g["out"], g["skip"], g["bias"][0] = np.einsum("tb,tbh->h", d, h), np.einsum("tb,tbi->i", d, grid), d.sum()
            d_h, d_x = d[:, :, None] * net.w["out"], d[:, :, None] * net.w["skip"]
            for way, steps, part in (("fore", fore, slice(0, HIDDEN)), ("back", back, slice(HIDDEN, None))):
                u, v = net.w[f"{way}_u"], net.w[f"{way}_v"]
                dh = dc = np.zeros((len(run), HIDDEN))
                for t, h0, c0, i, f, o, c_in, c1, _ in reversed(steps):
                    m = live[t][:, None]
                    dh = dh + d_h[t, :, part]
                    tanh = np.tanh(c1)
                    dct = dc + np.where(m, dh * o * (1 - tanh**2), 0)
                    dz = np.where(m, np.concatenate([dct * c_in * i * (1 - i), dct * c0 * f * (1 - f), dh * tanh * o * (1 - o), dct * i * (1 - c_in**2)], 1), 0)
                    g[f"{way}_u"] += grid[t].T @ dz
                    g[f"{way}_v"] += h0.T @ dz
                    g[f"{way}_b"] += dz.sum(0)
                    d_x[t] += dz @ u.T
                    dh = np.where(m, dz @ v.T, dh)
                    dc = np.where(m, dct * f, dc)
            flat_d = np.zeros((len(x), IN))
            flat_d[at[live]] = d_x[live]
            np.add.at(g["paths"], paths, np.repeat(flat_d[:, :PATH_DIM], n_path, axis=0))
            np.add.at(g["words"], words, np.repeat(flat_d[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(n_word, 1)[:, None], n_word, axis=0))
            step += 1
            for key, w in net.w.items():
                m1[key] = 0.9 * m1[key] + 0.1 * g[key]
                m2[key] = 0.99 * m2[key] + 0.01 * g[key] ** 2
                w -= rate * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)
    return net


#: Containers that other sites put an article in, and boilerplate with its place: before, after, or inside the article.
CONTAINERS = [("article",), ("main",), ("main", "article"), ("div.content",), ("div.post-content",), ("div#main-content", "div.entry"), ("section.article-body",), ("div.story-body",), ("article", "div.text"), ("div.entry-content",), ("main", "section.post")]
AROUND = [("before", "header"), ("before", "header.site-header", "div"), ("before", "div#header"), ("before", "nav"), ("before", "div.menu", "ul", "li"), ("before", "div.breadcrumbs"), ("before", "div.cookie-notice"), ("before", "div.alert-banner"), ("before", "form.search"), ("before", "div.masthead"), ("after", "footer"), ("after", "div#footer"), ("after", "aside"), ("after", "div.sidebar", "div.widget"), ("after", "section.comments", "div.comment"), ("after", "div#comments", "ol", "li"), ("after", "div.related", "ul", "li"), ("after", "form.newsletter"), ("after", "div.ad"), ("after", "div.social-share"), ("after", "div.copyright"), ("inside", "aside"), ("inside", "div.ad"), ("inside", "div.advertisement"), ("inside", "nav"), ("inside", "form"), ("inside", "section.comments", "div.comment"), ("inside", "div.newsletter-signup"), ("inside", "div.share-buttons"), ("inside", "div.promo"), ("inside", "footer")]


#: What stands around list items and cells of an article.
WITHIN = {"li": ("ul",), "td": ("table", "tr"), "figcaption": ("figure",)}


def path_of(chain: tuple[str, ...], last: str) -> tuple[str, ...]:
    import re

    names: dict[str, None] = {}
    for element in (*chain, last):
        tag, *more = re.split(r"[.#-]", element)
        names |= dict.fromkeys(["t:" + tag, *("c:" + w for w in more)])
    return tuple(names)


def rebuilt(page: list[Block], label: np.ndarray, rng: np.random.Generator, pool: list[str]) -> tuple[list[Block], np.ndarray]:
    """The page's blocks in another layout; `pool` gives the boilerplate's words."""
    chain = CONTAINERS[rng.integers(len(CONTAINERS))]
    inner = ["p", "p", "p", "h2", "blockquote", "li", "li", "pre", "td", "figcaption", "div"]
    body, own_header = [], False
    for k, b in enumerate(b for b, y in zip(page, label) if y):
        last = ("h1", "h1", "h1", "div.headline", "div.title")[rng.integers(5)] if k == 0 else inner[rng.integers(len(inner))]
        own_header = own_header or k == 0 and rng.random() < 0.3
        more = ("header",) if k == 0 and own_header else WITHIN.get(last, ())
        names, last = path_of((*chain, *more), last), last.split(".")[0]
        body.append((b._replace(path=hashed(names, last), names=names, linked=float(rng.random() * 0.3 * (rng.random() < 0.2))), 1))
    before, after = [], []
    around = [AROUND[j] for j in rng.permutation(len(AROUND))[: rng.integers(2, 9)]]
    if own_header:  # a page's header stands before an article that has one as well
        around.append(AROUND[rng.integers(2)])
    for where, *inside in around:
        last = ["p", "li", "div", "span", "h3" if rng.random() < 0.5 else "h2"][rng.integers(5)]
        names = path_of((*(chain if where == "inside" else ()), *inside), last)
        linked = float(rng.random() < 0.5)
        for _ in range(rng.integers(1, 5)):
            text = pool[rng.integers(len(pool))]
            if rng.random() < 0.6:
                text = " ".join(text.split()[: rng.integers(1, 12)])
            b = (Block(text, hashed(names, last), linked, names), 0)
            if where == "before":
                before.append(b)
            elif where == "after":
                after.append(b)
            else:
                body.insert(int(rng.integers(len(body) + 1)), b)
    rows = before + body + after
    return [b for b, _ in rows], np.array([y for _, y in rows], float)


def learned(pages: list[str], seed: int) -> Labeller | None:
    seen = [p for p in map(blocks, pages) if p]
    if not seen:
        return None
    labels = [np.array([is_content(b.names) for b in p], float) for p in seen]
    rng = np.random.default_rng(seed)
    pool = [b.text for p in seen for b in p]
    copies = 2 if len(seen) >= 100 else 5  # few pages are laid out anew more often
    both = list(zip(seen, labels)) + [rebuilt(p, y, rng, pool) for p, y in zip(seen, labels) if y.any() for _ in range(copies)]
    cut = [(p[i : i + WINDOW], y[i : i + WINDOW]) for p, y in both for i in range(0, len(p), WINDOW)]
    return fit([p for p, _ in cut], [y for _, y in cut])


def train(pages: DataFrame, max_pages: int = 400, seed: int = 11) -> Labeller | None:
    """max_pages: the most pages of the table that the labeller learns from, in the order of a hash of url and page_id.

    They meet in one task, which fits the labeller; the driver gets weights alone.
    """
    some = pages.filter(F.length("html") > 0).select("html", F.xxhash64("page_id", "url").alias("h"))
    last = some.select("h").orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]  # only hashes are sorted
    if last is None:
        return None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        net = learned(rows.sort_by([("h", "ascending"), ("html", "ascending")])["html"].to_pylist()[:max_pages], seed)
        w = net.w if net else {}
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.string()), pa.array([list(v.shape) for v in w.values()], pa.list_(pa.int64())), pa.array([v.ravel() for v in w.values()], pa.list_(pa.float64()))], names=["name", "shape", "values"])

    found = some.filter(F.col("h") <= last).limit(2 * max_pages).repartition(1).mapInArrow(learn, "name string, shape array<long>, values array<double>").collect()
    return Labeller({r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in found}) if found else None


def extract(pages: DataFrame, net: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in chunks(batches, column="html"):
            seen = [blocks(x or "") for x in batch.column("html").to_pylist()]
            keep = net.probabilities(seen) if net else [np.array([is_content(b.names) for b in p], float) for p in seen]
            texts = ["\n".join(b.text for b, k in zip(p, q.tolist()) if k >= 0.5) for p, q in zip(seen, keep)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
