"""Main text of web pages by a recurrent block labeller.

A page falls into leaf blocks: runs of text between the tags that break a
line.  Each block is read as the mean of learned vectors for its tag path
(names, classes and ids, hashed), the mean of learned vectors for its hashed
words, and a few measures.  A bidirectional LSTM in numpy runs over all blocks
of the page and says of each whether it belongs to the article.

The labeller is trained here on pages made by ``made_pages``: no page of any
table is a training row, as none has labels.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: Rows of the tag and word tables, their width, LSTM cells each way, measures of a block.
TAGS, WORDS, WIDTH, CELLS, MEASURES = 4096, 4096, 8, 16, 7
#: Made pages the labeller learns from, passes over them, pages in a step.
PAGES, EPOCHS, STEP = 1800, 14, 40
#: The largest step, and how fast tables shrink: most words of made pages are invented, so only those that keep teaching stay.
RATE, FADE = 0.02, {"words": 0.2}
#: Tags around whose borders a block ends, tags whose content is no text, and tags that never have content.
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SILENT = "script|style|template|noframes"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A p ends where one of these begins; a li, option, tr, td, th, dt or dd ends where the next of its kind begins.
ENDS_P = BREAKS - {"body", "head", "html", "title", "caption", "option", "optgroup"}
ITEMS = {"li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
HOLDS = {"li": ("ul", "ol", "menu"), "option": ("select",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}
#: Embedded drawings and players: their content is no text, but one without an end does not swallow the page.
EMBEDDED = {name: re.compile(rf"<(/?){name}\b[^>]*>", re.I) for name in ("svg", "math", "object", "canvas")}
TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<silent>{SILENT})\b[^>]*>.*?(?:</(?P=silent)\s*>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Distinct rows of the tag table that a path holds at most; a path's further names no longer count.
PATH_ROWS = 64


class Node:
    """An open element: its name, the one it stands in, how deep it is, and the rows of the tag table of its whole path."""

    __slots__ = ("name", "up", "depth", "rows", "headed")

    def __init__(self, name: str, up: Node | None, marks: tuple[str, ...] = ()):
        self.name, self.up, self.depth = name, up, up.depth + 1 if up else 1
        self.headed = name == "head" or bool(up and up.headed)
        known = up.rows if up else ()
        new = [r for r in element_rows(name, up.name if up else "", marks) if r not in known]
        # a path shares the rows of the one above where it adds none, and never holds more than PATH_ROWS
        self.rows = (*known, *new)[:PATH_ROWS] if new and len(known) < PATH_ROWS else known


@lru_cache(4096)
def element_rows(name: str, above: str, marks: tuple[str, ...]) -> tuple[int, ...]:
    """Rows of the tag table for an element: its name, its name under the one above, its classes and ids, and their parts."""
    names = {name, f"{above}/{name}", *marks} | {f".{w}" for p in marks for w in re.split(r"[-_\d]+", p[1:]) if w}
    return tuple(crc32(n.encode("utf-8", "replace")) % TAGS for n in sorted(names))


@dataclass
class Block:
    node: Node | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """Names of the open elements, outermost first."""
        names, at = [], self.node
        while at:
            names.append(at.name)
            at = at.up
        return tuple(reversed(names))


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's runs of text in order, character references decoded, white space made one space; empty ones are left out.

    Open elements are a stack; for each name the places where it is open are
    kept, so no tag searches the stack, however deep a broken page nests.
    """
    page = page or ""
    stack: list[Node] = []
    open_at: dict[str, list[int]] = {}
    breaks_at: list[int] = []
    out: list[Block] = []
    parts: list[str] = []
    node: Node | None = None
    linked = at = 0
    ends: dict[str, re.Match | None] = {}

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(node, text, linked))
        parts.clear()
        linked = 0

    def last(*names: str) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def leave(k: int) -> None:
        for n in reversed(stack[k:]):
            open_at[n.name].pop()
        while breaks_at and breaks_at[-1] >= k:
            breaks_at.pop()
        del stack[k:]

    def behind(name: str, here: int) -> int:
        """Where an embedded element that opens before ``here`` ends; here itself if it has no end of its own."""
        while (tag := ends.get(name, False)) is not None and (tag is False or tag.start() < here):
            ends[name] = EMBEDDED[name].search(page, here)
        return tag.end() if tag and tag[1] else here

    while m := TOKEN.search(page, at):
        if m.start() > at:
            if not parts:
                node = stack[-1] if stack else None
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * bool(open_at.get("a"))
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        breaks = name in BREAKS
        if breaks:
            close()
        elif name == "br":
            parts.append(" ")
        inmost = breaks_at[-1] if breaks_at else -1
        if m["end"]:
            # a closing inline tag does not reach out of the block that it stands in
            if (k := last(name)) >= 0 and (breaks or k > inmost):
                leave(k)
            continue
        if name in VOID:
            continue
        if name in EMBEDDED:
            at = at if m["rest"].endswith("/") else behind(name, at)
            continue
        if name in ITEMS and (k := last(*ITEMS[name])) > last(*HOLDS[name]):
            leave(k)
            inmost = breaks_at[-1] if breaks_at else -1
        if name in ENDS_P and inmost >= 0 and stack[inmost].name == "p":
            leave(inmost)
        marks = tuple(f".{w}" for g in NAMED.findall(m["rest"]) for w in "".join(g).lower().split()) if "=" in m["rest"] else ()
        if breaks:
            breaks_at.append(len(stack))
        open_at.setdefault(name, []).append(len(stack))
        stack.append(Node(name, stack[-1] if stack else None, marks))
    if at < len(page):
        if not parts:
            node = stack[-1] if stack else None
        parts.append(page[at:])
    close()
    return out


def readings(page: list[Block]) -> list[tuple[tuple[int, ...], list[int], tuple[float, ...]]]:
    """Of each block: rows of the tag table, rows of the word table, and measures of the block, its page and what it stands in."""
    longest, whole, held = max((len(b.text) for b in page), default=1), sum(len(b.text) for b in page), {}
    for b in page:
        around = id(b.node.up) if b.node else 0
        held[around] = held.get(around, 0) + len(b.text)
    out = []
    for b in page:
        words, n = b.text.split(), len(b.text)
        stops = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
        share = held[id(b.node.up) if b.node else 0] / whole
        measures = (np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / n), min(1.0, 8 * stops / n), min(b.node.depth if b.node else 0, 24) / 12, n / longest, share)
        out.append((b.node.rows if b.node else (0,), [crc32(w.lower().encode("utf-8", "replace")) % WORDS for w in words], measures))
    return out


class Batch:
    """Pages of blocks side by side: time runs down, pages across; shorter pages end with empty steps."""

    def __init__(self, pages: list[list[Block]]):
        self.sizes = np.array([len(p) for p in pages])
        self.shape = (int(self.sizes.max(initial=0)), len(pages))
        read = [r for p in pages for r in readings(p)]
        self.at = np.concatenate([np.arange(s) * len(pages) + k for k, s in enumerate(self.sizes)]) if len(read) else np.zeros(0, int)
        self.tags, self.tag_of, self.tag_n = self.flat([r[0] for r in read])
        self.words, self.word_of, self.word_n = self.flat([r[1] for r in read])
        self.measures = np.array([r[2] for r in read], np.float32).reshape(-1, MEASURES)
        self.mask = (np.arange(self.shape[0])[:, None] < self.sizes[None, :]).astype(np.float32)

    @staticmethod
    def flat(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in lists], np.int64)
        values = np.fromiter((v for x in lists for v in x), np.int64, int(n.sum()))
        return values, np.repeat(np.arange(len(lists)), n), np.maximum(n, 1)

    def inputs(self, w: dict) -> np.ndarray:
        def mean(table: np.ndarray, values: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(of, table[values, j], len(n)) for j in range(WIDTH)], 1) / n[:, None] if len(n) else np.zeros((0, WIDTH))

        x = np.zeros((self.shape[0] * self.shape[1], 2 * WIDTH + MEASURES), np.float32)
        x[self.at] = np.hstack([mean(w["tags"], self.tags, self.tag_of, self.tag_n), mean(w["words"], self.words, self.word_of, self.word_n), self.measures])
        return x.reshape(*self.shape, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """One LSTM over time; steps that are masked leave the state as it is."""
    steps, pages = mask.shape
    h = c = np.zeros((pages, CELLS), np.float32)
    gates_in = x.reshape(-1, x.shape[-1]) @ w + b
    gates_in = gates_in.reshape(steps, pages, -1)
    out, tape = np.zeros((steps, pages, CELLS), np.float32), []
    for t in range(steps):
        z = gates_in[t] + h @ u
        s = sigmoid(z[:, : 3 * CELLS])
        i, f, o, g = s[:, :CELLS], s[:, CELLS : 2 * CELLS], s[:, 2 * CELLS :], np.tanh(z[:, 3 * CELLS :])
        m = mask[t][:, None]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
    return out, tape


def back(dout: np.ndarray, x: np.ndarray, tape: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32), np.zeros_like(x)
    dh = dc = np.zeros((dout.shape[1], CELLS), np.float32)
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + dout[t]
        on, dnew = dh * m, dc * m
        do = on * tc
        dnew = dnew + on * o * (1 - tc * tc)
        dz = np.hstack([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)])
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w.T
        dh = dh * (1 - m) + dz @ u.T
        dc = dc * (1 - m) + dnew * f
    return dw, du, db, dx


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]

    def forward(self, batch: Batch, keep: bool = False):
        w, x = self.weights, batch.inputs(self.weights)
        ahead, tape_a = run(x, batch.mask, w["wa"], w["ua"], w["ba"], keep)
        behind, tape_b = run(x[::-1], batch.mask[::-1], w["wb"], w["ub"], w["bb"], keep)
        both = np.concatenate([ahead, behind[::-1], x], 2)
        return sigmoid(both @ w["v"] + w["c"]), both, x, tape_a, tape_b

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page belongs to the article."""
        batch = Batch(pages)
        p = self.forward(batch)[0]
        return [p[: batch.sizes[k], k] > 0.5 for k in range(len(pages))]


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """Adam on the blocks of made pages, in steps that shrink along a cosine; the same weights at every call."""
    made = [(leaf_blocks(page), inside) for page, inside in made_pages(pages, seed)]
    made = [(blocks, np.array([i in inside for i in range(len(blocks))], np.float32)) for blocks, inside in ((b, places(b, w)) for b, w in made)]
    rng, size = np.random.default_rng(seed), 2 * WIDTH + MEASURES
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"tags": normal(TAGS, WIDTH), "words": normal(WORDS, WIDTH), "v": normal(2 * CELLS + size), "c": np.zeros(1, np.float32)}
    for d in "ab":
        w |= {f"w{d}": normal(size, 4 * CELLS), f"u{d}": normal(CELLS, 4 * CELLS), f"b{d}": np.zeros(4 * CELLS, np.float32)}
        w[f"b{d}"][CELLS : 2 * CELLS] = 1
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    model, t = Labeller(w), 0
    made.sort(key=lambda m: len(m[0]))
    steps = [made[i : i + STEP] for i in range(0, len(made), STEP)]
    batches = [(Batch([m[0] for m in s]), s) for s in steps]
    for epoch in range(epochs):
        rate = RATE * (1 + np.cos(np.pi * epoch / epochs)) / 2 + RATE / 50
        for k in rng.permutation(len(steps)):
            batch, part = batches[k]
            y = np.zeros(batch.shape, np.float32)
            for j, (_, marks) in enumerate(part):
                y[: len(marks), j] = marks
            p, both, x, tape_a, tape_b = model.forward(batch, keep=True)
            d = (p - y) * batch.mask / max(1.0, batch.mask.sum()) * 10
            grads = {"v": np.tensordot(both, d, ([0, 1], [0, 1])), "c": np.array([d.sum()])}
            dboth = d[:, :, None] * w["v"]
            grads["wa"], grads["ua"], grads["ba"], dxa = back(dboth[:, :, :CELLS], x, tape_a, w["wa"], w["ua"])
            grads["wb"], grads["ub"], grads["bb"], dxb = back(dboth[::-1, :, CELLS : 2 * CELLS], x[::-1], tape_b, w["wb"], w["ub"])
            dx = (dxa + dxb[::-1] + dboth[:, :, 2 * CELLS :]).reshape(-1, size)[batch.at]
            for name, values, of, n, a in (("tags", batch.tags, batch.tag_of, batch.tag_n, 0), ("words", batch.words, batch.word_of, batch.word_n, WIDTH)):
                each = dx[:, a : a + WIDTH] / n[:, None]
                grads[name] = np.stack([np.bincount(values, each[of, j], len(w[name])) for j in range(WIDTH)], 1)
            t += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                w[name] = (w[name] * (1 - rate * FADE.get(name, 0)) - rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return model


@lru_cache(1)
def labeller() -> Labeller:
    return train()


def places(blocks: list[Block], marked: list[str]) -> set[int]:
    """Positions of the article's blocks: their texts in order."""
    found, k = set(), 0
    for i, block in enumerate(blocks):
        if k < len(marked) and block.text == marked[k] and not (block.node and block.node.headed):
            found.add(i)
            k += 1
    return found


#: What menus, notices, adverts, footers and comments say about themselves; none of it is of the tables.
SAID = {
    "nav": "home about contact menu news products help login search next previous categories archive".split(),
    "header": "welcome login search menu skip content sign subscribe".split(),
    "footer": "copyright © rights reserved terms privacy policy imprint contact powered".split(),
    "side": "related posts popular read more tags share follow recent archive".split(),
    "ad": "advertisement sponsored buy offer sale shop discount deal free trial order".split(),
    "notice": "cookies cookie consent accept site subscribe newsletter dismiss privacy".split(),
    "form": "name email password send submit search message required".split(),
    "comments": "comments reply says posted commented report likes thread".split(),
}
#: How each part may be named where the page names its parts.
NAMED_PARTS = {
    "nav": ["nav", "nav", "div class='menu'", "div id='nav'", "ul class='navigation'", "nav class='breadcrumb'", "menu"],
    "header": ["header", "header class='site-header'", "div class='header'", "div id='masthead'", "div class='banner'"],
    "footer": ["footer", "footer", "footer class='site-footer'", "div class='footer'", "div id='footer'"],
    "side": ["aside", "aside class='sidebar'", "div class='sidebar'", "div id='sidebar'", "div class='related'", "section class='related-posts'", "div class='widget'", "div class='share social'"],
    "ad": ["div class='ad'", "div class='ad'", "div class='advert'", "div class='ads banner'", "aside class='ad'", "div id='ad-top'", "div class='sponsored promo'", "section class='advertisement'"],
    "notice": ["div class='notice'", "div class='cookie-notice'", "div id='cookie-banner'", "div class='alert'", "div role='alert'", "section class='notice'", "div class='newsletter subscribe'", "div class='popup modal'"],
    "form": ["form", "form class='search'", "form id='login'", "form action='/s'"],
    "comments": ["section class='comments'", "div id='comments'", "div class='comments'", "ol class='comment-list'", "div class='responses reader-comments'", "section id='disqus'"],
    "main": ["article", "article", "article", "main", "div class='content'", "div id='main'", "section class='post'", "div class='entry-content article-body'", "main><article"],
}


def made_pages(count: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Pages with their article's blocks: invented words, and layouts from plainly named parts to nameless ones, rows of a table, and a bare body.

    A nameless part is told by its links, its length, its place and what it
    says, so these teach as well as names do.
    """
    rng = Random(seed)
    syllables = "an be co da er fi gu ha in jo ka le mo na or pe qui ra se ti um ve wo za ar ción que eau ung sch heit the tion".split()
    pick, chance = rng.choice, lambda p: rng.random() < p

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(rng.randrange(1, 4)))
        return w.upper() + "!!" if style == 1 else w + pick(["###", "$$$", "%%%", "***", "&amp;&amp;&amp;"]) if style == 2 else w

    def words(a: int, b: int) -> str:
        text = [word() for _ in range(rng.randrange(a, b))]
        text[0] = text[0][:1].upper() + text[0][1:]
        return " ".join(w + "," * chance(0.06) for w in text) + pick([".", ".", "!", ""])

    def para() -> str:
        if chance(0.03):
            return " ".join([word().capitalize() + pick([".", " |"])] * rng.randrange(1, 30))
        if chance(0.03):
            return " | ".join(words(1, 3) for _ in range(rng.randrange(1, 25)))
        return " ".join(words(4, 16) for _ in range(rng.randrange(1, 6))) if chance(0.75) else words(1, 5)

    def saying(kind: str, a: int, b: int) -> str:
        """Words of which some are the part's own, more of them where nothing else names it."""
        own = 0.3 if naming == "named" else 0.7
        text = [pick(SAID[kind]) if chance(own) else word() for _ in range(rng.randrange(a, b))]
        if naming != "named":
            text[0] = pick(SAID[kind])
        return (" ".join(text)).capitalize() + pick([".", "", "!"])

    def links(kind: str, n: int) -> str:
        item = pick(["<li><a href='/{0}'>{0}</a></li>", "<li><a href=\"/x\">{0}</a>", "<a href='/{0}'>{0}</a> | ", "<p><a href='/{0}'>{0}</a></p>", "<div><a href='#'>{0}</a></div>"])
        inner = "".join(item.format(saying(kind, 1, 4) if chance(0.4) else words(1, 4)) for _ in range(n))
        return f"{pick(['<ul>', '<ul>', '<ol>'])}{inner}</ul>" if "<li>" in item else inner

    def wrap(kind: str) -> str:
        """An opening tag without its brackets: named for what it holds, or by a code, or not at all."""
        if naming == "named":
            return pick(NAMED_PARTS[kind])
        tag = pick(["div", "div", "div", "section"]) if kind != "form" or naming == "none" else "form"
        return f"{tag} {pick(['class', 'class', 'id'])}='{pick('bcdkmqrtvxz')}{rng.randrange(100)}'" if chance(0.6) else tag

    def other(kind: str) -> str:
        n, own = rng.randrange(2, 9), naming != "named"
        few = "".join(f"<p>{saying(kind, 3, 22) if own or chance(0.5) else para()}</p>" for _ in range(rng.randrange(1, 3))) if chance(0.4) else saying(kind, 3, 14) if own else words(3, 14)
        if kind == "nav":
            body = links(kind, n)
        elif kind == "header":
            body = f"<h1>{words(1, 5)}</h1>" * (not own and chance(0.3)) + few + links(kind, 3) * (own or chance(0.3))
        elif kind == "footer":
            body = pick(["&copy; ", "&copy; host.example &middot; ", f"&copy; {rng.randrange(1990, 2030)} ", "" if naming == "named" else f"Copyright {rng.randrange(1990, 2030)} - "]) + few + links(kind, 3) * chance(0.3)
        elif kind == "side":
            body = f"<h3>{saying(kind, 1, 4)}</h3>" * chance(0.6) + (links(kind, n) if own or chance(0.5) else few)
        elif kind == "notice":
            body = few + "<button>OK</button>" * chance(0.5)
        elif kind == "form":
            body = f"<label>{saying(kind, 1, 4)}</label><input name='q'><p>{saying(kind, 1, 6)}</p><select><option>{words(1, 3)}<option>{words(1, 3)}</select><button>{saying(kind, 1, 3)}</button>"
        elif kind == "comments":
            shape = pick(["<div class='comment'><p>{}</p></div>", "<p class='comment'>{}</p>", "<article class='comment'><p>{}</p></article>", "<li class='comment'>{}</li>", "<p>{}</p>"] if not own else ["<div>{}</div>", "<p>{}</p>", "<li>{}</li>"])
            said = lambda: f"{words(1, 3)} {pick(['says', 'commented', 'posted', 'reply'])}: {para()}" if own else para()
            body = f"<h2>{saying(kind, 1, 4)}</h2>" * (own or chance(0.7)) + "".join(shape.format(said()) for _ in range(rng.randrange(1, 6)))
        else:
            body = few
        if layout == "table" and naming != "named" and chance(0.4):
            return body  # the cell itself holds it
        name = wrap(kind)
        return f"<{name}>{body}</{name.split()[0]}>"

    for _ in range(count):
        style, naming, marked, main = rng.choice([0, 0, 0, 1, 2]), pick(["named", "named", "named", "coded", "none"]), [], []
        layout = pick(["wrapped", "wrapped", "table", "bare"]) if naming != "named" else pick(["wrapped", "wrapped", "wrapped", "wrapped", "table", "bare"])
        title = words(2, 9)

        def add(markup: str, text: str) -> None:
            main.append(markup)
            marked.append(" ".join(html.unescape(text).split()))

        if chance(0.85):
            level = pick(["h1", "h1", "h2"])
            add(f"<{level}>{title}</{level}>", title)
        for _ in range(rng.randrange(1, pick([3, 6, 14]))):
            text, kind = para(), rng.random()
            if kind < 0.44:
                add(f"<p>{text}</p>", text)
            elif kind < 0.56:
                more = words(2, 9)
                add(f"<p><b>{text}<br>", text)
                add(f"<p>{more}</p>", more)
            elif kind < 0.62:
                add(f"<p>{text}", text)
            elif kind < 0.69:
                level = pick(["h2", "h2", "h3"])
                add(f"<{level}>{words(1, 8) if chance(0.7) else text}</{level}>", "")
                marked[-1] = " ".join(html.unescape(re.sub("<[^>]*>", "", main[-1])).split())
            elif kind < 0.75:
                items, tag = [words(1, 9) for _ in range(rng.randrange(1, 5))], pick(["ul", "ol"])
                main.append(f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>")
                marked += [" ".join(html.unescape(i).split()) for i in items]
            elif kind < 0.79:
                add(f"<blockquote>{text}</blockquote>", text)
            elif kind < 0.83:
                add(f"<pre>{text}</pre>", text)
            elif kind < 0.86:
                term, told = words(1, 3), words(2, 12)
                add(f"<dl><dt>{term}</dt>", term)
                add(f"<dd>{told}</dd></dl>", told)
            elif kind < 0.89:
                add(f"<figure><img src='x.png'><figcaption>{text}</figcaption></figure>", text)
            elif kind < 0.92:
                add(f"<div>{text}</div>", text)
            elif kind < 0.94:
                add(f"<p><a href='/x'>{text}</a> {title} <em>{text}</em></p>", f"{text} {title} {text}")
            elif kind < 0.96:
                add(f"<table><tr><td>{text}</table>", text)
            elif naming == "named":
                main.append(other(pick(["ad", "side", "form", "notice"])))
        if chance(0.25):
            last = words(1, pick([2, 3]))
            add(f"<p>{last}</p>", last)
        tail = other("comments") if chance(0.3) else ""
        place = wrap("main") if naming != "named" else pick(NAMED_PARTS["main"])
        if naming == "none" and chance(0.3):
            place = pick(["main", "article", "section"])
        closing = "".join(f"</{t.split()[0]}>" for t in reversed(place.split("><")))
        inside = chance(0.3)
        before = [other(k) for k in ("header", "nav", "notice", "ad", "side", "form") if chance(0.42)]
        after = [other(k) for k in ("ad", "side", "nav", "form", "notice") if chance(0.25)] + ([other("footer")] if chance(0.9) else [])
        rng.shuffle(before)
        content = "".join(main) + tail * inside
        if layout == "wrapped":
            body = "".join(before) + f"<{place}>" + content + closing * chance(0.95) + tail * (not inside) + "".join(after)
        elif layout == "table":
            cell = pick(["</td><td>", "</td></tr><tr><td>"])
            body = "<table><tr><td>" + cell.join([*before, content, tail * (not inside), *after]) + "</td></tr></table>"
        else:
            body = "".join(before) + content + tail * (not inside) + "".join(after)
        yield f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{title}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{body}" + "</body></html>" * chance(0.9), marked


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the article's blocks of each page in order, joined by an empty line.

    Null and empty pages, and pages without a block that counts, have an empty
    text.  Repeated rows stay, null ids and urls too; other columns are not read.
    """
    sent = batched(pages).sparkSession.sparkContext.broadcast(labeller())

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            texts = [""] * len(batch)
            split = [leaf_blocks(h.as_py()) for h in batch]
            order = sorted((k for k in range(len(split)) if split[k]), key=lambda k: len(split[k]))
            while order:
                # pages of like length run together, about 20,000 steps at a time
                n = max(1, min(256, 20_000 // len(split[order[-1]])))
                part, order = order[-n:], order[:-n]
                for k, marks in zip(part, model.label([split[k] for k in part])):
                    texts[k] = "\n\n".join(b.text for b, m in zip(split[k], marks) if m)
            yield pa.array(texts, pa.string())

    return pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), extracted(F.col(html_col)).alias("text"))
