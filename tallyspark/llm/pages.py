"""Main text of web pages: every block of a page is labelled by a recurrent network.

A page is cut into blocks: runs of text between tags that are not inline, with the path of open
elements (names, and words of class, id and role) and the share of link text. A bidirectional
LSTM in numpy reads a page's blocks as one sequence, each as hashed vectors of its path, of its
innermost element and of its words with a few measures, so a block's label takes the whole page
into account. Blocks above the threshold, in page order, are the main text.

The network is trained on the driver on a bounded sample: at most `sample` pages of at most
`SAMPLE_BYTES` bytes, those with the smallest hashes. Their labels come from markup that names its
own role (text in <article> or <main> and in nothing like <nav> or class="ad" is main text).
As pages often name roles otherwise or not at all, each sampled page is also rebuilt a few
times: its main blocks in containers with other names or none, with menus, headers, sidebars,
notices, adverts, forms, comments and footers around and among them whose names come from the
lists below and whose texts come from those lists and from other pages.

Scripts, styles, templates, comments and the head are no blocks. Character references are
decoded; a block's white space is one space. Tags may be unclosed, unopened or cut off; text
after an unfinished tag is part of the tag. Of a path, the PATH_DEPTH innermost elements count.
Null and empty pages give the empty text. Rows with equal or null ids are pages of their own.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENS, chunks, ship

SAMPLE, SAMPLE_BYTES, REBUILT, LEAST_REBUILT = 500, 1 << 16, 2, 800
THRESHOLD = 0.5
PATH_DIMS, LEAF_DIMS, WORD_DIMS, HIDDEN = 96, 32, 32, 24
PATH_DEPTH = 32
#: Blocks that a step of the network holds at once, and pages with more blocks are read in slices of.
CELLS, SLICE = 16_384, 4096
#: Bytes of pages parsed at once.
PAGE_BYTES = 4 << 20
EPOCHS, BATCH, RATE, SEED = 8, 32, 4e-3, 13

# Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = ("script", "style", "template", "noscript", "iframe", "svg", "title", "object", "math")
#: An element that opens closes an open one of these beside it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words that name what a part of a page is, by markup in use on the web.
MAIN = ("article", "main")
ASIDE = frozenset("nav header footer aside form button select label dialog menu".split())
ROLES = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs topnav sitenav toc pagination pager tabs",
    "header": "header masthead banner top branding logo site-title topbar site-header",
    "sidebar": "sidebar aside side rail widget widgets right-col secondary related recommended popular trending more-stories",
    "notice": "notice cookie cookies cookie-notice consent gdpr alert warning popup modal overlay announcement paywall disclaimer message",
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion promoted banner-ad adsbygoogle ad-slot",
    "form": "form newsletter subscribe signup login search search-form contact-form poll",
    "comments": "comments comment comment-list commentlist discussion replies reply disqus responses reader-comments user-comments",
    "share": "share social sharing tools follow likes tags meta author-box byline",
    "footer": "footer bottom copyright legal site-footer colophon foot credits imprint",
}
CONTAINERS = ("article", "main", "main article", "div.content", "div.article-body", "div.post div.entry-content", "section.story", "div.main-content", "div.post-content", "div.text", "div.container div.body", "td", "div", "div div", "section", "div.page div.article", "")
PHRASES = {
    "menu": "Home|News|About us|Contact|Sport|Products|Startseite|Accueil|Inicio|Blog|Archive|Next|Previous|Help|Shop|Kontakt|FAQ",
    "header": "Welcome to our site|Your daily source of news|The Daily Example|Skip to content|Log in|Sign up|Menu|Search|Willkommen|Bienvenue",
    "sidebar": "Most read|Related articles|Popular posts|You may also like|Recent posts|Read more|Categories|Trending now|Archives|Follow us",
    "notice": "We use cookies to improve your experience.|Accept all|By continuing you agree to our use of cookies.|Please enable JavaScript.|This site uses cookies.|Subscribe to read on.|Wir verwenden Cookies.|Nous utilisons des cookies.|You have 2 free articles left.",
    "ad": "Advertisement|Sponsored|Buy now and save 50%|Limited offer|Click here|Shop today|Anzeige|Publicité|Free trial|Order now",
    "form": "Your email address|Subscribe|Name|Message|Send|Sign up for our newsletter|Password|Submit|Search|I agree to the terms",
    "comments": "3 comments|Reply|Great article, thanks!|I do not agree with this at all.|Posted by guest|Leave a comment|Log in to reply|Anonymous says:|2 hours ago|Report|First!",
    "share": "Share|Tweet|Share on Facebook|Print|Email this|Tags: news|By the editors|5 min read|Follow|Published yesterday",
    "footer": "© 2024 Example Inc.|All rights reserved.|Privacy policy|Terms of use|Imprint|Contact|Copyright|Impressum|Mentions légales|Sitemap",
}
SENTENCES = "The first part of the text tells what happened and who was there. Nobody knew at the time how long it would last.|After some days the water went back, and people came to see what was left of their houses.|Much of the work is still to be done, as the report says on its last page."

_ROLE_WORDS = frozenset(w for names in ROLES.values() for n in names.split() for w in (n, n.replace("-", " ").split()[0]))
_ATTRS = r"""(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(DROPPED)})\b{_ATTRS}(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    path: str
    text: str
    linked: int


def element(name: str, attrs: str) -> str:
    """An open element as one word: its name, then the words of class, id and role."""
    words = dict.fromkeys(w for _, value in _NAMED.findall(attrs) for w in _WORD.findall(value.lower())) if "=" in attrs else ()
    return ".".join([name, *words])


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in its order; see the module's text."""
    out: list[Block] = []
    open_: list[str] = []  # elements that are not inline
    parts: list[str] = []
    linked, links, head, at = 0, 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not head:
                out.append(Block(" ".join(open_[-PATH_DEPTH:]), text, linked))
            parts.clear()
        linked = 0

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if m[2] else 1  # links do not nest
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if name in ("head", "body"):
            head = name == "head" and not m[2]
        if m[2]:
            for i in range(len(open_) - 1, max(-1, len(open_) - 1 - 10 * PATH_DEPTH), -1):
                if open_[i].partition(".")[0] == name:
                    del open_[i:]
                    break
            continue
        while open_ and (top := open_[-1].partition(".")[0]) in ("p", *CLOSES.get(name, ())):
            open_.pop()
            if top == name:
                break
        if name not in VOID and not m[4].rstrip().endswith("/"):
            open_.append(element(name, m[4]))
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    flush()
    return out


_path_vectors: dict[str, np.ndarray] = {}


def path_vector(path: str) -> np.ndarray:
    """Hashed words of a path's elements, and of its last one."""
    found = _path_vectors.get(path)
    if found is None:
        if len(_path_vectors) > 50_000:
            _path_vectors.clear()
        found = np.zeros(PATH_DIMS + LEAF_DIMS, dtype=np.float32)
        elements = path.split(" ") if path else []
        for i, e in enumerate(elements):
            name, *words = e.split(".")
            for w in (f"<{name}", *(f".{w}" for w in words)):
                h = zlib.crc32(w.encode())
                sign = 1.0 if h >> 31 else -1.0
                found[h % PATH_DIMS] += sign
                if i == len(elements) - 1:
                    found[PATH_DIMS + (h >> 8) % LEAF_DIMS] += sign
        _path_vectors[path] = found = np.clip(found, -2, 2)
    return found


_SIGNS = np.zeros((256, 3), dtype=np.float32)
_SIGNS[[ord(c) for c in ".,;:!?"], 0] = 1
_SIGNS[0x30:0x3A, 1] = 1
_SIGNS[0x41:0x5B, 2] = 1
MEASURES = 10
WIDTH = PATH_DIMS + LEAF_DIMS + WORD_DIMS + MEASURES


def block_features(blocks: list[Block], place: np.ndarray, total: np.ndarray) -> np.ndarray:
    """One row per block; place: its place in its page, total: its page's number of blocks."""
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    for i, b in enumerate(blocks):
        out[i, : PATH_DIMS + LEAF_DIMS] = path_vector(b.path)
    words, measures = PATH_DIMS + LEAF_DIMS, WIDTH - MEASURES
    linked = np.array([b.linked for b in blocks], dtype=np.float32)
    for c in chunks(pa.array([b.text for b in blocks], pa.string()), kinds=TOKENS):
        own, n = slice(c.lo, c.hi), np.maximum(c.n_words, 1)[:, None]
        h = c.hashes(7, lower=True)
        owner = np.repeat(np.arange(c.hi - c.lo), c.n_words)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        sums = np.bincount(owner * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), weights=sign, minlength=(c.hi - c.lo) * WORD_DIMS)
        out[own, words:measures] = (sums.reshape(-1, WORD_DIMS) / np.sqrt(n)).astype(np.float32)
        size = np.diff(c.ends).astype(np.float32)
        counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(_SIGNS[c.data, k], dtype=np.float64)])[c.ends]) for k in range(3)], axis=1)
        out[own, measures : measures + 3] = counts / size[:, None] * 10
        out[own, measures + 3] = np.log1p(size) / 4
        out[own, measures + 4] = np.log1p(c.n_words) / 3
        out[own, measures + 5] = np.minimum(1, linked[own] / size)
    out[:, measures + 6] = place / np.maximum(total - 1, 1)
    out[:, measures + 7] = np.log1p(np.minimum(total, 60)) / 4  # longer pages are all alike to it
    out[:, measures + 8] = place == 0
    out[:, measures + 9] = place == total - 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Direction:
    """One direction of the network; gates in the order in, forget, out, new."""

    def __init__(self, rng: np.random.Generator, width: int, hidden: int):
        self.hidden = hidden
        self.x = (rng.normal(size=(width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
        self.h = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, dtype=np.float32)
        self.b[hidden : 2 * hidden] = 1
        self.out = (rng.normal(size=hidden) / np.sqrt(hidden)).astype(np.float32)

    def read(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = False) -> tuple[np.ndarray, tuple, list]:
        """Scores (steps x pages) of inputs (steps x pages x width), the last state, and what `learn` needs if kept."""
        n, k = self.hidden, x.shape[1]
        h, c = state or (np.zeros((k, n), dtype=np.float32), np.zeros((k, n), dtype=np.float32))
        gates = x @ self.x + self.b
        scores, tape = np.empty(x.shape[:2], dtype=np.float32), []
        for t in range(len(x)):
            z = gates[t] + h @ self.h
            s = sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            if keep:
                before = (h, c)
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            scores[t] = h @ self.out
            if keep:
                tape.append((*before, i, f, o, g, th, h))
        return scores, (h, c), tape

    def learn(self, x: np.ndarray, tape: list, d_scores: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, h, b and out for those of the scores."""
        n = self.hidden
        d_gates = np.empty((*x.shape[:2], 4 * n), dtype=np.float32)
        d_h, d_c = np.zeros_like(tape[0][0]), np.zeros_like(tape[0][0])
        d_hh, d_out = np.zeros_like(self.h), np.zeros_like(self.out)
        for t in range(len(x) - 1, -1, -1):
            h0, c0, i, f, o, g, th, h = tape[t]
            d_out += d_scores[t] @ h
            d_h = d_h + d_scores[t][:, None] * self.out
            d_c = d_c + d_h * o * (1 - th * th)
            d = d_gates[t]
            d[:, :n] = d_c * g * i * (1 - i)
            d[:, n : 2 * n] = d_c * c0 * f * (1 - f)
            d[:, 2 * n : 3 * n] = d_h * th * o * (1 - o)
            d[:, 3 * n :] = d_c * i * (1 - g * g)
            d_hh += h0.T @ d
            d_h, d_c = d @ self.h.T, d_c * f
        flat = d_gates.reshape(-1, 4 * n)
        return [x.reshape(-1, x.shape[2]).T @ flat, d_hh, flat.sum(0), d_out]

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.h, self.b, self.out]


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse; its padding stays at the end."""
    steps = np.arange(len(x))[:, None]
    at = np.where(steps < lengths[None, :], lengths[None, :] - 1 - steps, steps)
    return np.take_along_axis(x, at.reshape(*at.shape, *[1] * (x.ndim - 2)), 0)


class Labeller:
    """The network: a score for each block from what comes before it and what comes after it."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(rng, width, hidden), Direction(rng, width, hidden)
        self.bias = np.zeros(1, dtype=np.float32)

    def parts(self) -> list[np.ndarray]:
        return [*self.ahead.parts(), *self.back.parts(), self.bias]

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log odds (steps x pages) of padded pages."""
        return self.ahead.read(x)[0] + turned(self.back.read(turned(x, lengths))[0], lengths) + self.bias

    def scores_of_long(self, slices: Iterator[np.ndarray], again: Iterator[np.ndarray]) -> np.ndarray:
        """Log odds of one page whose features come in slices, from first to last and from last to first."""
        ahead, back, state = [], [], None
        for x in slices:
            s, state, _ = self.ahead.read(x[:, None], state)
            ahead.append(s[:, 0])
        state = None
        for x in again:
            s, state, _ = self.back.read(x[::-1][:, None], state)
            back.append(s[::-1, 0])
        return np.concatenate(ahead) + np.concatenate(back[::-1]) + self.bias

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the blocks and gradients of `parts`."""
        inside = np.arange(len(x))[:, None] < lengths[None, :]
        other = turned(x, lengths)
        s1, _, tape1 = self.ahead.read(x, keep=True)
        s2, _, tape2 = self.back.read(other, keep=True)
        z = s1 + turned(s2, lengths) + self.bias
        loss = float((np.logaddexp(0, z) - labels * z)[inside].mean())
        d = np.where(inside, sigmoid(z) - labels, 0).astype(np.float32) / inside.sum()
        return loss, [*self.ahead.learn(x, tape1, d), *self.back.learn(other, tape2, turned(d, lengths)), np.array([d.sum()], dtype=np.float32)]


def features_of(pages: list[list[Block]]) -> list[np.ndarray]:
    """The features of some pages' blocks."""
    lengths = np.array([len(p) for p in pages])
    ends = np.cumsum(lengths)
    place = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
    return np.split(block_features([b for p in pages for b in p], place, np.repeat(lengths, lengths)), ends[:-1])


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    out = np.zeros((int(lengths.max()), len(pages), *pages[0].shape[1:]), dtype=np.float32)
    for j, p in enumerate(pages):
        out[: len(p), j] = p
    return out, lengths


def fit(examples: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller trained by Adam on pages with labelled blocks."""
    model, rng = Labeller(seed=seed), np.random.default_rng(seed)
    data = [(x, np.array(y, dtype=np.float32)) for b, y in examples if b for x in features_of([b])]
    first = [np.zeros_like(p) for p in model.parts()]
    second = [np.zeros_like(p) for p in model.parts()]
    step = 0
    for _ in range(epochs):
        # pages of like length together, batches in random order
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]), rng.random()))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            x, lengths = padded([data[i][0] for i in batches[k]])
            y, _ = padded([data[i][1] for i in batches[k]])
            _, grads = model.gradients(x, lengths, y)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for p, g, a, b in zip(model.parts(), grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def markup_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks in <article> or <main> below which nothing names another role."""
    out = []
    for b in blocks:
        elements = [e.split(".") for e in b.path.split(" ")]
        main = [i for i, e in enumerate(elements) if e[0] in MAIN]
        below = elements[main[-1] :] if main else []
        out.append(int(bool(main) and not any(e[0] in ASIDE or _ROLE_WORDS & set(e[1:]) for e in below)))
    return out


def rebuilt(rng: random.Random, main: list[Block], others: list[str]) -> tuple[list[Block], list[int]]:
    """A page of the main blocks with other containers and other parts around and among them."""
    anonymous = rng.random() < 0.08  # nothing names its role
    bare = rng.random() < 0.08  # there are no other parts
    outer = rng.choice(["html body", "html body", ""])
    container = rng.choice(CONTAINERS)
    named = not anonymous and ("." in container or "main" in container or "article" in container)
    out: list[tuple[Block, int]] = []

    def path(*elements: str) -> str:
        own = " ".join(e for e in elements if e)
        if anonymous:
            own = " ".join("div" if e.split(".")[0] in (*MAIN, *ASIDE, "section") else e.split(".")[0] for e in own.split(" "))
        return f"{outer} {own}".strip()

    def part(role: str, *inside: str) -> None:
        if bare:
            return
        name = rng.choice(ROLES[role].split())
        words = ".".join(name.split("-"))
        tags = {"menu": "nav", "header": "header", "sidebar": "aside", "form": "form", "footer": "footer", "comments": "section"}
        box = tags[role] + ("" if rng.random() < 0.5 else f".{words}") if role in tags and rng.random() < 0.5 else f"{rng.choice(['div', 'div', 'section', 'ul', 'td', 'aside'])}.{words}"
        inner = rng.choice(["", "div", "ul li", "p", "ol li", "div p", "h3", "ul li div p"])
        linky = rng.random() < {"menu": 0.95, "sidebar": 0.6, "footer": 0.5, "share": 0.7}.get(role, 0.1)
        for _ in range(rng.randint(1, 7 if role in ("menu", "comments", "sidebar") else 3)):
            phrase = rng.choice(PHRASES[role].split("|"))
            long = others and rng.random() < {"comments": 0.6, "ad": 0.6, "sidebar": 0.4, "notice": 0.3, "footer": 0.3, "header": 0.2, "menu": 0.5}.get(role, 0.1)
            text = rng.choice(others) if long else phrase
            if long:
                own = text.split(" ")
                n = rng.randint(1, 3) if role == "menu" else rng.randint(3, 40)
                low = rng.randrange(max(1, len(own) - n))
                text = " ".join(own[low : low + n])
                if role == "footer" and rng.random() < 0.6:
                    text = f"{phrase} {text}"
            out.append((Block(path(*inside, box, inner), text, len(text) if linky else 0), 0))

    for role in ("header", "notice", "menu", "ad", "share", "sidebar"):
        if rng.random() < (0.7 if role == "menu" else 0.35):
            part(role)
    inset = {rng.randrange(1, len(main)): rng.choice(["ad", "notice", "share", "form", "sidebar", "menu"]) for _ in range(rng.randint(0, 2))} if len(main) > 2 else {}
    for i, b in enumerate(main):
        if i in inset:
            part(inset[i], container)
        tag = "h1" if i == 0 and rng.random() < 0.6 else rng.choice(["p"] * 8 + ["h2", "ul li", "blockquote", "div", "ol li", "div p", ""])
        text = b.text
        if named and rng.random() < 0.15:  # odd texts are main text, too, where the page says so
            text = rng.choice([rng.choice(PHRASES[rng.choice(list(PHRASES))].split("|")), str(rng.getrandbits(60)), text.split(" ")[0], " ".join(text.split(" ")[:1] * 20)])
        out.append((Block(path(container, tag), text, rng.choice([0] * 5 + [len(text) // 4])), 1))
    for role in ("share", "ad", "form", "comments", "sidebar", "notice", "footer"):
        if rng.random() < (0.6 if role in ("comments", "footer") else 0.3):
            part(role, *([container] if role in ("share", "comments", "form") and rng.random() < 0.4 else []))
    return [b for b, _ in out], [y for _, y in out]


def training_pages(pages: list[str], times: int = REBUILT, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """The pages whose markup tells the main text, and rebuilt ones."""
    rng = random.Random(seed)
    read = [(b, markup_labels(b)) for b in map(page_blocks, pages)]
    told = [(b, y) for b, y in read if any(y)]
    mains = [[x for x, keep in zip(b, y, strict=True) if keep] for b, y in told]
    # without such markup, longer blocks stand for main text
    mains += [] if mains else [[x for x in b if len(x.text) > 80] for b, _ in read]
    mains = [m for m in mains if m] + [[Block("", s, 0) for s in SENTENCES.split("|")]]
    others = [x.text for m in mains for x in m]
    # few pages are rebuilt more often
    times = max(times, LEAST_REBUILT // len(mains))
    # whole ones, short ones and, now and then, very long ones
    cut = lambda m: rng.choice([m, m[: rng.randint(1, 6)]]) if rng.random() > 0.03 else (m * 150)[:150]
    rebuilt_pages = [rebuilt(rng, cut(m), others) for m in mains for _ in range(times)]
    # pages whose blocks have each other's texts: where markup tells a block's role, its words don't matter
    for b, y in told[::2]:
        texts = [x.text for x in b]
        rng.shuffle(texts)
        rebuilt_pages.append(([Block(x.path, t, len(t) if x.linked else 0) for x, t in zip(b, texts, strict=True)], y))
    return told + rebuilt_pages


def fit_on_pages(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller from a bounded sample of the column `html`."""
    own = F.col("html").cast("string")
    key = F.xxhash64(own)
    small = pages.where(F.octet_length(own) <= SAMPLE_BYTES).select(own.alias("html"), key.alias("_key"))
    # of many pages only those with small hashes are sorted, so few are sent to the driver
    share = min(1.0, 4 * sample / max(pages.count(), 1))
    few = small.where(F.pmod("_key", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else small
    rows = few.orderBy(F.pmod("_key", F.lit(1 << 30)), "_key", "html").limit(sample).collect()
    return fit(training_pages([r["html"] for r in rows]))


def page_texts(pages: list[str | None], model: Labeller, threshold: float) -> list[str]:
    """The main texts of some pages."""
    out = [""] * len(pages)
    blocks = {i: b for i, p in enumerate(pages) if p and (b := page_blocks(p))}
    cut = np.log(threshold / (1 - threshold))

    def tell(i: int, scores: np.ndarray) -> None:
        out[i] = "\n".join(b.text for b, s in zip(blocks[i], scores, strict=True) if s >= cut)

    group: list[int] = []

    def read_group() -> None:
        x, lengths = padded(features_of([blocks[i] for i in group]))
        scores = model.scores(x, lengths)
        for j, i in enumerate(group):
            tell(i, scores[: lengths[j], j])
        group.clear()

    for i in sorted(blocks, key=lambda i: len(blocks[i])):
        own = blocks[i]
        n = len(own)
        if n > SLICE:
            slices = [(lo, min(n, lo + SLICE)) for lo in range(0, n, SLICE)]
            of = lambda lo, hi: block_features(own[lo:hi], np.arange(lo, hi), np.full(hi - lo, n))  # noqa: B023, E731
            tell(i, model.scores_of_long((of(*s) for s in slices), (of(*s) for s in reversed(slices))))
            continue
        if group and (len(group) + 1) * n > CELLS:
            read_group()
        group.append(i)
    if group:
        read_group()
    return out


def text_batches(batches: Iterator[pa.RecordBatch], model: Labeller, threshold: float) -> Iterator[pa.RecordBatch]:
    """The other columns with the main text and its code points, some megabytes of pages at a time."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("html")), 0)).cumsum()
        lo = 0
        while lo < batch.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + PAGE_BYTES, side="right")))
            some = batch.slice(lo, hi - lo)
            texts = page_texts(some.column("html").to_pylist(), model, threshold)
            others = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(some.column(n) for n in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, "text", "n_chars"])
            lo = hi


def main_texts(pages: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    ship(pages.sparkSession)
    model = fit_on_pages(pages, sample)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: text_batches(it, model, threshold), "page_id long, url string, text string, n_chars long")
