"""Main text of web pages: a recurrent labeller over each page's blocks.

A page is read into leaf blocks: runs of text that no block-level element
interrupts, with the open elements above them.  Each block becomes a vector (its
tag path with classes, ids and roles; its words; shape figures such as length, share
of link text and place), and a bidirectional LSTM reads the blocks of the whole
page in both directions before it decides on each one, so a block is judged by
what surrounds it.

The network is trained on about ``TRAIN_PAGES`` different pages, drawn by a hash of their text.  A
transparent teacher marks their blocks by telling names in the tag path, and by
length, links and place where the path says nothing: long unlinked blocks, the blocks
between two of them in the same parent, and headings right above; variants of the pages with renamed
wrappers and with inserted sidebars, notices, adverts, forms and reader comments
teach it layouts that the sample lacks.  Training and labelling are numpy; Spark
deals the pages out.

Every page is read whole.  Character references are decoded, white space inside a
block becomes one space, blocks are joined by an empty line.  Null and empty pages
have an empty text; markup that is cut off or never closed is read as far as it
goes (only script, style, textarea, iframe and noscript run to the end of the page);
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostercast.llm.common import row_sample, table

TRAIN_PAGES = 250
VARIANTS = 3
PATH, WORD, SHAPE = 160, 32, 10
HIDDEN, EPOCHS, PAGES_EACH, RATE = 12, 8, 48, 0.02
TOGETHER = 20_000  # blocks that are labelled together

# HTML's void, raw-text, inline and paragraph-ending elements; elements without main text that count if they are closed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|textarea|iframe"
EMBEDDED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("svg", "object", "template", "select")}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Names in paths that tell the teacher what a block is.
FURNITURE = frozenset("nav header footer aside form menu dialog title head button ad ads adv advert advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar side rail widget breadcrumb breadcrumbs pagination pager toolbar navbar navigation topbar masthead copyright legal disclaimer share sharing social related recommended subscribe subscription newsletter signup login search comment comments commentlist respond reply replies discussion disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main content body-text story post entry text articlebody".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")

Block = tuple[str, tuple[tuple[str, ...], ...], float]  # text, path (tag, names), share of link text

_paths: dict[tuple, np.ndarray] = {}
_words: dict[str, int] = {}


def names_of(rest: str) -> tuple[str, ...]:
    return tuple(PART.findall(" ".join(a or b or c for a, b, c in NAMED.findall(rest)).lower())) if "=" in rest else ()


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    path: list[tuple[str, ...]] = []
    held: list[str] = []
    links, in_link = 0, 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, tuple(path), min(1.0, links / len(text))))
            held.clear()
            links = 0

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        if text := m["text"]:
            held.append(text)
            if in_link:
                links += len(text)
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            elif tag == "br":
                held.append(" ")
            continue
        if tag in EMBEDDED and not m["end"]:
            if m["rest"].endswith("/"):
                continue
            if tag not in unclosed:
                if close := EMBEDDED[tag].search(page, at):
                    at = close.end()
                    continue
                unclosed.add(tag)  # from here on
        flush()
        if m["end"]:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == tag:
                    del path[i:]
                    break
            in_link = 0
        elif tag not in VOID:
            if path and path[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or path and path[-1][0] == "p":
                path.pop()
            path.append((tag, *names_of(m["rest"])))
    flush()
    return out


def named(path: tuple[tuple[str, ...], ...]) -> bool | None:
    """Whether the names in a path tell of the article; None if they tell nothing."""
    article = False
    for element in path:
        if element[0] == "header" and article:
            continue  # an article's own heading
        if any(x in FURNITURE for x in element):
            return False
        article = article or any(x in ARTICLE for x in element)
    return article or None


def told(page: list[Block]) -> list[bool]:
    """The teacher's marks: is each block part of the article?"""
    by_name = [named(path) for _, path, _ in page]
    long = [name is None and len(text.split()) >= 10 and linked < 0.5 for name, (text, _, linked) in zip(by_name, page, strict=True)]
    marks = [bool(name) or x for name, x in zip(by_name, long, strict=True)]
    last: dict[tuple, int] = {}  # the last long block of each parent
    for i in np.flatnonzero(long).tolist():
        parent = page[i][1][:-1]
        for j in range(last.get(parent, i) + 1, i):
            if by_name[j] is None and page[j][2] < 0.5 and page[j][1][: len(parent)] == parent:
                marks[j] = True
        for j in range(i - 1, -1, -1):
            _, path, linked = page[j]
            if by_name[j] is not None or linked >= 0.5 or not path or path[:-1] != parent or path[-1][0] not in HEADINGS:
                break
            marks[j] = True
        last[parent] = i
    return marks


def crc(word: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word)


def path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    v = _paths.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for element in path:
            for x in element:
                v[crc(x) % PATH] = 1
        if path:
            v[crc("last " + path[-1][0]) % PATH] += 1
        if len(_paths) > 100_000:
            _paths.clear()
        _paths[path] = v
    return v


def word_slot(word: str) -> int:
    slot = _words.get(word)
    if slot is None:
        if len(_words) > 200_000:
            _words.clear()
        slot = _words[word] = crc(word) % WORD
    return slot


def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block."""
    out = np.zeros((len(page), PATH + WORD + SHAPE), np.float32)
    for i, (text, path, linked) in enumerate(page):
        words = text.lower().split()
        out[i, :PATH] = path_vector(path)
        bag = np.bincount(list(map(word_slot, words)), minlength=WORD)
        out[i, PATH : PATH + WORD] = bag / math.sqrt(float((bag * bag).sum()))
        n = len(text)
        out[i, -SHAPE:] = (
            math.log1p(n) / 5, math.log1p(len(words)) / 4, linked, text[-1] in ".!?…»”", text.count(",") * 10 / n, text.count(".") * 10 / n,
            text[0].isupper(), i / len(page), 1 / (1 + i), 1 / (len(page) - i))
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output, trained by Adam."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d, h = PATH + WORD + SHAPE, HIDDEN
        self.w = [rng.normal(0, 1 / math.sqrt(d + h), (d + h, 4 * h)).astype(np.float32) for _ in range(2)]
        self.b = [np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for _ in range(2)]
        self.v, self.c = rng.normal(0, 0.3, 2 * h).astype(np.float32), np.zeros(1, np.float32)
        self.m = [np.zeros_like(x) for x in self.all()]
        self.s = [np.zeros_like(x) for x in self.all()]
        self.t = 0

    def all(self) -> list[np.ndarray]:
        return [*self.w, *self.b, self.v, self.c]

    def one_way(self, x: np.ndarray, mask: np.ndarray, way: int, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (pages, blocks, HIDDEN); ``way`` 1 reads from the end."""
        n, steps, d = x.shape
        w, h = self.w[way], HIDDEN
        given = x.reshape(-1, d) @ w[:d] + self.b[way]
        given = given.reshape(n, steps, 4 * h)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, log = np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            on = mask[:, t, None]
            z = given[:, t] + state @ w[d:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                log.append((t, state, cell, i, f, o, g, tanh))
            state, cell = np.where(on, o * tanh, state), np.where(on, new, cell)
            out[:, t] = state
        return out, log

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        a, la = self.one_way(x, mask, 0, keep)
        b, lb = self.one_way(x, mask, 1, keep)
        both = np.concatenate([a, b], axis=2)
        return both @ self.v + self.c[0], (both, la, lb)

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rate: float = RATE) -> float:
        """One step on a batch of pages; the mean loss before it."""
        z, (both, *logs) = self.logits(x, mask, True)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = ((p - y) * mask / mask.sum()).astype(np.float32)
        d, h = x.shape[2], HIDDEN
        grads = [np.zeros_like(g) for g in self.all()]
        grads[4], grads[5] = (both * slope[..., None]).sum((0, 1)), np.array([slope.sum()], np.float32)
        for way, log in enumerate(logs):
            w = self.w[way]
            down = slope[..., None] * self.v[way * h : way * h + h]
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            for t, state, cell, i, f, o, g, tanh in reversed(log):
                on = mask[:, t, None]
                ds = ds + down[:, t]
                dn = np.where(on, dc + ds * o * (1 - tanh * tanh), 0)
                dz = np.concatenate([dn * g * i * (1 - i), dn * cell * f * (1 - f), np.where(on, ds * tanh, 0) * o * (1 - o), dn * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                grads[way][d:] += state.T @ dz
                ds, dc = np.where(on, dz @ w[d:].T, ds), np.where(on, dn * f, dc)
            flat = dz_all.reshape(-1, 4 * h)
            grads[way][:d] = x.reshape(-1, d).T @ flat
            grads[2 + way] = flat.sum(0)
        self.t += 1
        for k, (value, g) in enumerate(zip(self.all(), grads, strict=True)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            value -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        loss = -(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        return float((loss * mask).sum() / mask.sum())

    def chosen(self, pages: list[list[Block]]) -> list[list[bool]]:
        """For every block of every page, whether it is main text."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]), reverse=True)
        while order:
            n = max(1, TOGETHER // len(pages[order[0]]))
            now, order = order[:n], order[n:]
            x, mask = padded([vectors(pages[i]) for i in now])
            z, _ = self.logits(x, mask)
            for row, i in enumerate(now):
                out[i] = (z[row, : len(pages[i])] >= 0).tolist()
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), most, rows[0].shape[1]), np.float32), np.zeros((len(rows), most), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


def varied(page: list[Block], spare: list[Block], rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A variant of a marked page: wrappers renamed, foreign furniture put in."""
    furniture, article = sorted(FURNITURE - {"title", "head"}), sorted(ARTICLE)
    as_div = {}

    def renamed(element: tuple[str, ...]) -> tuple[str, ...]:
        if element not in as_div:
            pool = furniture if any(x in FURNITURE for x in element) else article if any(x in ARTICLE for x in element) else None
            as_div[element] = element if pool is None or rng.random() < 0.4 else (str(rng.choice(["div", "section"])), str(rng.choice(pool)))
        return as_div[element]

    rows = [((t, tuple(renamed(e) for e in path), link), mark) for (t, path, link), mark in zip(page, told(page), strict=True)]
    inner = [path for (_, path, _), mark in rows if mark]
    for _ in range(int(rng.integers(1, 4))):
        name, tag = str(rng.choice(furniture)), str(rng.choice(["div", "section", "ul"]))
        inside = inner[0][:-1] if inner and rng.random() < 0.6 else (("html",), ("body",))
        wrapper = (name,) if name in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else (tag, name)
        leaf = str(rng.choice(["p", "div", "li", "h3"]))
        link = 1.0 if rng.random() < 0.3 else 0.0
        group = [((spare[int(i)][0], (*inside, wrapper, (leaf,)), link), False) for i in rng.integers(0, len(spare), int(rng.integers(1, 5)))]
        at = int(rng.integers(0, len(rows) + 1))
        rows[at:at] = group
    return rows


def trained(pages: list[str]) -> Labeller:
    """The labeller for a sample of pages."""
    rng = np.random.default_rng(5)
    read = [b for b in map(blocks, pages) if b]
    spare = [b for page in read for b in page]
    marked = [list(zip(page, told(page), strict=True)) for page in read]
    marked += [varied(page, spare, rng) for _ in range(VARIANTS) for page in read]
    x = [vectors([b for b, _ in page]) for page in marked]
    y = [np.array([m for _, m in page], np.float32) for page in marked]
    net = Labeller()
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        order = order[np.argsort([len(x[i]) // 8 for i in order], kind="stable")]  # pages of like length together
        groups = [order[a : a + PAGES_EACH] for a in range(0, len(order), PAGES_EACH)]
        for g in rng.permutation(len(groups)):
            batch, mask = padded([x[i] for i in groups[g]])
            goal = np.zeros(mask.shape, np.float32)
            for row, i in enumerate(groups[g]):
                goal[row, : len(y[i])] = y[i]
            batch[:, :, :PATH] *= rng.random((len(batch), 1, PATH)) > 0.05  # no single name carries a page
            net.learn(batch, mask, goal, RATE * (1 - epoch / EPOCHS) ** 2)
    return net


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with a column ``text`` in place of ``page``; an older column ``text`` gives way, all others stay whatever their names."""
    sample = sorted(r.h for r in row_sample(pages.select(F.col(f"`{page}`").alias("h")).where("h is not null"), TRAIN_PAGES).collect())  # about TRAIN_PAGES
    net = trained(sample) if sample else Labeller()
    others = [c for c in pages.columns if c not in (page, "text")]
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{page}`").alias("h"))
    out = T.StructType([T.StructField("row", row.schema["row"].dataType), T.StructField("text", T.StringType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                read = [blocks(h.as_py() or "") for h in batch.column(1)]
                texts = ["\n\n".join(b[0] for b, mark in zip(page_, marks) if mark) for page_, marks in zip(read, net.chosen(read), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return row.mapInArrow(extracted, out).select("row.*", "text")


def op4_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
