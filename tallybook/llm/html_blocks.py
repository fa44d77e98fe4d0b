"""Main text of web pages by a recurrent labeller of their blocks.

A page becomes its sequence of blocks: runs of text between block tags, with the path of
open tags, their classes and ids. A bidirectional LSTM reads a vector for each block -
hashed path parts, hashed words, a few measures - and gives each the probability of being
article text, so a block is judged with all blocks before and behind it. Blocks from 0.5
on are joined.

The model is trained here, in numpy, on pages drawn by a fixed seed from a grammar of
templates (`TRAIN_PAGES`, the bound of the fit): articles in several kinds of containers
among menus, headers, sidebars, adverts, notices, forms, comments and footers, also with
boilerplate inside the article. Words are random, so it learns structure. It needs a few
seconds once per driver process; tasks get its 30,000 numbers.

Cases: a null, empty or text-free page has the empty text; scripts, styles, comments and
the head hold no blocks; a head ends at the first tag or text that cannot stand in it, other
hidden elements without an end at their parent's or at the next container; unclosed tags and pages that end in a tag or reference are read
as far as they go; a page of any length is one sequence; repeated rows stay; a null url
stays null; result columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as part of the page.
HIDDEN_TAGS = frozenset("head script style template noscript title svg iframe object".split())
#: Any other tag ends the head.
HEAD_TAGS = frozenset("html head title meta link base script style noscript template".split())
#: An opening tag ends open elements of these kinds, up to the next container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main "
                       "menu nav ol section table ul".split())
#: Quotes count only right after an equals sign; without their end, the tag ends at its next >.
VALUE = r"=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)"
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:{VALUE}|[^>])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PATHS, WORDS_, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 1024, 1024, 12, 6, 6, 16
TRAIN_PAGES, EPOCHS, SEED = 400, 12, 11
#: Padded blocks that run together, about 2 KB each.
BATCH_BLOCKS = 8192


@dataclass
class Block:
    path: list[str]
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def page_blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order."""
    page = page or ""
    stack: list[tuple[str, list[str]]] = []
    blocks: list[Block] = []
    now: Block | None = None
    at, hidden, links, in_head = 0, None, 0, False
    inside: list[str] = []  # open elements of a hidden one
    last_close: dict[str, int] = {}

    def add(raw: str) -> None:
        nonlocal now
        if raw.strip() == "" and now is None:
            return
        if now is None:
            now = Block([part for _, parts in stack for part in parts])
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                blocks.append(now)
        now = None

    for tag in MARKUP.finditer(page):
        if hidden is None and tag.start() > at:
            if in_head and page[at:tag.start()].strip():
                in_head = False
            if not in_head:
                add(page[at:tag.start()])
        if tag.start() < at:
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        ending = tag[1] == "/"
        if hidden is not None:
            if ending and name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name):]
                continue
            if ending and name == hidden:
                hidden = None
                continue
            # Without an end of its own it ends with its parent, or at the next container.
            parent = ending and any(name == n for n, _ in stack)
            if name == "body" or parent or not ending and name in CONTAINERS and last_close[hidden] < at:
                hidden = None
            else:
                if name in ("script", "style") and not ending:
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else at
                elif not ending and name not in VOID_TAGS and not tag[3].endswith("/"):
                    inside.append(name)
                continue
        if in_head and name not in HEAD_TAGS:
            in_head = False
        if name in HIDDEN_TAGS:
            if name == "head":
                in_head = not ending
            elif not ending:
                if name in ("script", "style", "title"):  # their text may look like tags
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    if end is None and name == "title":
                        at = page.find("<", at) if page.find("<", at) >= 0 else len(page)
                    else:
                        at = end.end() if end else len(page)
                elif not tag[3].endswith("/"):
                    hidden, inside = name, []
                    if name not in last_close:
                        ends = re.finditer(rf"</{name}(?=[\s/>])", page, re.I)
                        last_close[name] = max((e.start() for e in ends), default=-1)
            continue
        if name == "br":
            add(" ")
        if name in BLOCK_TAGS:
            close()
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS and name not in CONTAINERS:
                    break
            links = sum(n == "a" for n, _ in stack)
        elif name not in VOID_TAGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CONTAINERS or name not in ENDS:
                    break
                if stack[i][0] in ENDS[name]:
                    del stack[i:]
                    break
            parts = [name]
            for kind, *values in NAMES.findall(tag[3]):
                for value in "".join(values).lower().split():
                    parts += [f".{value}", *(f".{p}" for p in re.split(r"[-_]+", value) if p != value)]
            stack.append((name, parts))
            links = sum(n == "a" for n, _ in stack)
    if hidden is None and at < len(page) and (not in_head or page[at:].strip()):
        add(page[at:])
    close()
    return blocks


@functools.lru_cache(maxsize=200_000)
def _slot(kind: str, value: str, size: int) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) % size


def block_inputs(blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Path slots, word slots and measures of each block."""
    paths = [[_slot("p", p, PATHS) for p in b.path] for b in blocks]
    words = [[_slot("w", w, WORDS_) for w in re.findall(r"\w+|©", b.text.lower())] for b in blocks]
    rows = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        rows.append((
            np.log1p(n) / 5, min(1.0, b.linked / n), float(b.text[-1] in ".!?…\"”"),
            float(any(p in ("h1", "h2", "h3") for p in b.path)), np.log1p(len(b.path)) / 3, (i + 0.5) / len(blocks),
        ))
    return paths, words, np.array(rows, dtype=np.float64).reshape(-1, MEASURES)


class BlockLabeller:
    """A bidirectional LSTM over the blocks of pages, padded to the longest of a batch."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + MEASURES
        self.w = {"path": np.zeros((PATHS, PATH_DIM)), "word": np.zeros((WORDS_, WORD_DIM)),
                  "out": rng.normal(0, 0.2, 2 * HIDDEN), "out_bias": np.zeros(1)}
        for way in ("f", "b"):
            self.w[f"{way}_x"] = rng.normal(0, size ** -0.5, (size, 4 * HIDDEN))
            self.w[f"{way}_h"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            self.w[f"{way}_bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _batch(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Inputs (page, block, feature) and mask, with the flat slots that gradients go back to."""
        longest = max(len(p[2]) for p in pages)
        x = np.zeros((len(pages), longest, PATH_DIM + WORD_DIM + MEASURES))
        mask = np.zeros((len(pages), longest))
        flat: list[list[np.ndarray]] = [[], []]
        for kind, (name, at) in enumerate((("path", 0), ("word", PATH_DIM))):
            slots = [s for p in pages for row in p[kind] for s in row]
            lengths = [len(row) for p in pages for row in p[kind]]
            where = [(i, j) for i, p in enumerate(pages) for j in range(len(p[2]))]
            owner = np.repeat(np.arange(len(where)), lengths)
            share = np.repeat(1 / np.maximum(1, lengths) if name == "word" else np.ones(len(lengths)), lengths)
            sums = np.zeros((len(where), self.w[name].shape[1]))
            if slots:
                np.add.at(sums, owner, self.w[name][slots] * share[:, None])
            spots = np.array(where).reshape(-1, 2)
            x[spots[:, 0], spots[:, 1], at:at + sums.shape[1]] = sums
            flat[kind] = [np.array(slots, dtype=int), owner, share, spots]
        for i, p in enumerate(pages):
            x[i, :len(p[2]), PATH_DIM + WORD_DIM:] = p[2]
            mask[i, :len(p[2])] = 1
        return x, mask, flat[0], flat[1]

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """States of one direction, and what backpropagation needs if it is to be kept."""
        pages, longest, _ = x.shape
        h = c = np.zeros((pages, HIDDEN))
        drive = x @ self.w[f"{way}_x"] + self.w[f"{way}_bias"]
        states, tape = np.zeros((pages, longest, HIDDEN)), []
        for t in range(longest) if way == "f" else range(longest - 1, -1, -1):
            z = drive[:, t] + h @ self.w[f"{way}_h"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN:(k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[:, t:t + 1]
            fresh = f * c + i * g
            if keep:
                tape.append((t, h, c, i, f, o, g, np.tanh(fresh), on))
            h, c = on * (o * np.tanh(fresh)) + (1 - on) * h, on * fresh + (1 - on) * c
            states[:, t] = h
        return states, tape

    def probabilities(self, pages: list[tuple]) -> list[np.ndarray]:
        x, mask, _, _ = self._batch(pages)
        both = np.concatenate([self._run(way, x, mask, keep=False)[0] for way in ("f", "b")], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["out_bias"], -30, 30)))
        return [row[:len(page[2])] for row, page in zip(p, pages, strict=True)]

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over blocks and its gradients, by backpropagation through time."""
        x, mask, paths, words = self._batch(pages)
        y = np.zeros(mask.shape)
        for row, label in zip(y, labels, strict=True):
            row[:len(label)] = label
        runs = {way: self._run(way, x, mask) for way in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["out_bias"], -30, 30)))
        n = mask.sum()
        loss = -float(np.sum(mask * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))) / n)
        error = mask * (p - y) / n
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"], grads["out_bias"] = np.einsum("pt,pth->h", error, both), np.array([error.sum()])
        dx = np.zeros_like(x)
        for way, at in (("f", 0), ("b", HIDDEN)):
            w_h, w_x = self.w[f"{way}_h"], self.w[f"{way}_x"]
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, tanh_c, on in reversed(runs[way][1]):
                dh = dh + error[:, t:t + 1] * self.w["out"][at:at + HIDDEN]
                inner = on * (dc + dh * o * (1 - tanh_c ** 2))
                dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), on * dh * tanh_c * o * (1 - o), inner * i * (1 - g ** 2)], axis=1)
                grads[f"{way}_x"] += x[:, t].T @ dz
                grads[f"{way}_h"] += h.T @ dz
                grads[f"{way}_bias"] += dz.sum(0)
                dx[:, t] += dz @ w_x.T
                dh, dc = dz @ w_h.T + (1 - on) * dh, inner * f + (1 - on) * dc
        for name, (slots, owner, share, spots), at in (("path", paths, 0), ("word", words, PATH_DIM)):
            if len(slots):
                back = dx[spots[:, 0], spots[:, 1], at:at + self.w[name].shape[1]]
                np.add.at(grads[name], slots, back[owner] * share[:, None])
        return loss, grads

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int, batch: int = 32, rate: float = 0.01) -> None:
        """Adam over batches in an order fixed by the seed."""
        rng = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
                step += 1
                _, grads = self.gradients([pages[i] for i in at], [labels[i] for i in at])
                for k, g in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


#: What stands around articles: (opening tags, kind of inside). The words are signs on such parts.
AROUND = {
    "nav": (["<nav>", "<div class='menu'>", "<div id='navigation'>", "<ul class='nav'>", "<div class='navbar'>", "<div class='breadcrumb'>", "<div class='pagination'>"], "links"),
    "header": (["<header>", "<div id='header'>", "<div class='site-header'>", "<div class='masthead'>", "<div class='topbar'>"], "short"),
    "ad": (["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='sponsored'>", "<div class='banner-ad'>", "<div id='promo'>", "<aside class='ad'>", "<div class='advertisement'>"], "any"),
    "side": (["<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div class='related'>", "<section class='related-posts'>", "<div class='share'>", "<div class='social'>", "<div class='tags'>"], "mixed"),
    "notice": (["<div class='notice'>", "<div class='cookie-notice'>", "<div id='cookie-banner'>", "<div class='consent'>", "<div class='alert'>", "<div class='popup'>", "<div role='alert'>", "<div class='newsletter'>"], "any"),
    "form": (["<form>", "<form class='search'>", "<div class='subscribe'><form>", "<form id='login'>"], "form"),
    "comments": (["<section class='comments'>", "<div class='comments'>", "<div id='comments'>", "<ol class='comment-list'>", "<div class='comment'>", "<div class='reader-comments'>", "<div class='discussion'>"], "comments"),
    "footer": (["<footer>", "<div id='footer'>", "<div class='footer'>", "<div class='copyright'>", "<div class='site-footer'>"], "footer"),
}
ARTICLES = ["<article>", "<article class='post'>", "<main>", "<main><article>", "<div class='content'>", "<div id='content'>",
            "<div class='article-body'>", "<div class='post'>", "<div class='entry-content'>", "<div class='story'>", "<section class='text'>", "<div id='main'>", "<div>"]


class _Draw:
    """Random pages; a block's label is marked by a sign that is taken out again."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(s) for s in ("bcdfglmnprstv", "aeiouäéó", "nrstl ")).strip() for _ in range(150)]

    def words(self, low: int, high: int) -> str:
        made = ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return " ".join(made).capitalize() + self.r.choice(["", ".", ".", "."])

    @staticmethod
    def closed(tags: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", tags)))

    def around(self, kind: str) -> str:
        r, (openings, inside) = self.r, AROUND[kind]
        tags = r.choice(openings)
        if inside == "links":
            item = r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a>", "<p><a href='#'>{}</a></p>"])
            text = "".join(item.format(self.words(1, 3)) for _ in range(r.randint(2, 9)))
            text = f"<ul>{text}</ul>" if "<li>" in item and r.random() < 0.8 else text
        elif inside == "form":
            text = f"<label>{self.words(1, 3)}</label><input name='q'><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button>"
        elif inside == "comments":
            each = r.choice(["<p>{}</p>", "<div class='comment'><b>{a}</b><p>{}</p></div>", "<li><p>{}</p></li>", "<div>{}</div>"])
            text = f"<h3>{r.choice(['Comments', '3 Comments', self.words(1, 3)])}</h3>" * (r.random() < 0.6)
            text += "".join(each.format(self.words(2, 60), a=self.words(1, 2)) for _ in range(r.randint(1, 6)))
        elif inside == "footer":
            text = r.choice(["&copy; 2020 {}", "&copy; {} &middot; {}", "<p>{}</p><p>&copy; {}</p>", "{}"]).format(self.words(1, 6), self.words(1, 14))
        elif inside == "mixed":
            text = f"<h3>{self.words(1, 4)}</h3>" * r.randint(0, 1) + "".join(
                r.choice(["<p>{}</p>", "<ul><li><a href='/y'>{}</a></li></ul>", "<a href='/z'>{}</a> "]).format(self.words(1, 25)) for _ in range(r.randint(1, 5)))
        else:
            text = r.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<h2>{}</h2>"]).format(self.words(1, 8 if inside == "short" else 40))
        return tags + text + self.closed(tags)

    def article(self) -> str:
        r, out, tags = self.r, [], self.r.choice(ARTICLES)
        if r.random() < 0.7:
            out.append(r.choice(["<h1>\x01{}</h1>", "<h2>\x01{}</h2>", "<h1><b>\x01{}</b></h1>"]).format(self.words(2, 10)))
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 25])):
            form = r.choice(["<p>\x01{}</p>"] * 10 + ["<p><b>\x01{}<br>", "<p>\x01{}", "<h2>\x01{}</h2>", "<blockquote>\x01{}</blockquote>",
                             "<ul><li>\x01{}</li><li>\x01{}</li></ul>", "<pre>\x01{}</pre>", "<div>\x01{}</div>", "<p>\x01{} <a href='/q'>x</a></p>"])
            out.append(form.format(self.words(1, r.choice([3, 20, 120])), self.words(1, 20)))
            if r.random() < 0.08:
                out.append(self.around(r.choice(["ad", "side", "notice", "form"])))
        if r.random() < 0.2:
            out.append(self.around("comments"))
        return tags + "".join(out) + self.closed(tags)

    def page(self) -> str:
        r = self.r
        before = [self.around(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.45]
        behind = [self.around(k) for k in ("comments", "side", "ad", "form", "notice", "nav") if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(behind)
        foot = [self.around("footer")] * (r.random() < 0.8)
        wrap = r.choice(["", "", "<div id='page'>", "<div class='wrapper'>", "<div class='container'>"])
        body = wrap + "".join([*before, self.article() * (r.random() < 0.97), *behind, *foot]) + self.closed(wrap)
        return f"<html><head><title>x</title></head><body>{body}" + "</body></html>" * (r.random() < 0.9)


@functools.lru_cache(maxsize=2)
def trained_labeller(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
    """The model fitted on drawn pages; the same numbers at every call."""
    draw, inputs, labels = _Draw(seed), [], []
    for _ in range(pages):
        blocks = page_blocks(draw.page())
        if not blocks:
            continue
        labels.append(np.array([float("\x01" in b.text) for b in blocks]))
        for b in blocks:
            b.text = b.text.replace("\x01", "").strip() or "x"
        inputs.append(block_inputs(blocks))
    model = BlockLabeller(seed)
    model.fit(inputs, labels, epochs)
    return model


def _batches(order: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Pages in the order given, as many as fit into BATCH_BLOCKS once padded to the longest; one at least."""
    part: list[int] = []
    for i in order:
        if part and (len(part) + 1) * sizes[i] > BATCH_BLOCKS:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def main_blocks(pages: list[str | None], model: BlockLabeller) -> list[list[str]]:
    """The texts of the article blocks of each page. Pages of like length run together."""
    found = [page_blocks(p) for p in pages]
    order = sorted((i for i, blocks in enumerate(found) if blocks), key=lambda i: len(found[i]))
    kept: list[list[str]] = [[] for _ in pages]
    for part in _batches(order, [len(blocks) for blocks in found]):
        for i, p in zip(part, model.probabilities([block_inputs(found[i]) for i in part]), strict=True):
            kept[i] = [b.text for b, q in zip(found[i], p, strict=True) if q >= 0.5]
    return kept


def with_main_text(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """pages with main_text (article blocks joined by a blank line) and main_blocks (their texts)."""
    labeller = model or trained_labeller()

    @F.pandas_udf("main_text string, main_blocks array<string>")
    def of_page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            kept = main_blocks(list(pages), labeller)
            yield pd.DataFrame({"main_text": ["\n\n".join(k) for k in kept], "main_blocks": kept})

    read = pages.drop("main_text", "main_blocks").withColumn("_main", of_page(F.col("html").cast("string")))
    return read.select("*", "_main.*").drop("_main")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    read = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
