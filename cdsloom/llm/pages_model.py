"""A bidirectional LSTM in numpy that labels a sequence of blocks, and the pages it learns from.

A block is given by hashed tokens of its tag path, hashed words, and a few
numbers; both kinds of token have vectors of their own that are learned too.
The pages to learn from are drawn from rules: where pages keep their text, and
what stands around it.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

PATHS, WORDS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 2048, 1024, 16, 6, 3, 20
PAGES, EPOCHS, BATCH, RATE, SEED = 900, 7, 30, 0.01, 5
#: Steps whose inputs are multiplied at once.
CHUNK = 1024


@dataclass
class Block:
    """Text between block tags, the tokens of its tag path, and how many of its words are links'."""

    text: str
    path: tuple[str, ...]
    linked: int = 0
    main: bool = field(default=False, compare=False)


Groups = tuple[np.ndarray, np.ndarray]


def bag(groups: Groups, table: np.ndarray, mean: bool) -> np.ndarray:
    """Sum or mean of the rows of ``table`` for each group: places, and where each group, never empty, starts among them."""
    places, ptr = groups
    out = np.add.reduceat(table[places], ptr[:-1], 0)
    return out / np.diff(ptr).astype(out.dtype)[:, None] if mean else out


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """An LSTM over (time, sequence, feature); a mask of 0 leaves the state as it is."""

    @staticmethod
    def forward(x, mask, wx, wh, b, learn=True):
        """Outputs of all steps, and what backward() needs of each; without ``learn`` nothing is kept for it."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        hs, keep = np.zeros((steps, n, HIDDEN), x.dtype), []
        for t in range(steps):
            if t % CHUNK == 0:
                pre = x[t : t + CHUNK] @ wx + b
            z = pre[t % CHUNK] + h @ wh
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh = np.tanh(c_new)
            if learn:
                keep.append((h, c, i, f, o, g, tanh, m))
            c = m * c_new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            hs[t] = h
        return hs, keep

    @staticmethod
    def backward(dhs, x, keep, wx, wh):
        steps, n, _ = x.shape
        dz_all = np.zeros((steps, n, 4 * HIDDEN), x.dtype)
        dwh = np.zeros_like(wh)
        dh, dc = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        for t in reversed(range(steps)):
            h, c, i, f, o, g, tanh, m = keep[t]
            dh = dh + dhs[t]
            own, down = dh * m, dc * m
            dcn = down + own * o * (1 - tanh**2)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), own * tanh * o * (1 - o), dcn * i * (1 - g**2)], 1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh = dh * (1 - m) + dz @ wh.T
            dc = dc * (1 - m) + dcn * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return dz_all @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(SEED)
        size = PATH_DIM + WORD_DIM + NUMBERS
        shape = {"path": (PATHS, PATH_DIM), "word": (WORDS, WORD_DIM), "out": (2 * HIDDEN + size, 1), "bias": (1,)}
        for d in "fb":
            shape |= {f"{d}x": (size, 4 * HIDDEN), f"{d}h": (HIDDEN, 4 * HIDDEN), f"{d}b": (4 * HIDDEN,)}
        self.w = weights or {k: rng.normal(0, 0.0 if len(s) == 1 else 0.2, s).astype(np.float32) for k, s in shape.items()}

    def _inputs(self, blocks):
        """blocks: (path groups, word groups, numbers) of all sequences' blocks, one after the other."""
        paths, words, numbers = blocks
        return np.concatenate([bag(paths, self.w["path"], False), bag(words, self.w["word"], True), numbers], 1)

    def _run(self, flat, lens, learn=True):
        steps, n = int(max(lens)), len(lens)
        seq = np.repeat(np.arange(n), lens)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        x, mask = np.zeros((steps, n, flat.shape[1]), flat.dtype), np.zeros((steps, n), flat.dtype)
        x[at, seq], mask[at, seq] = flat, 1.0
        w = self.w
        hf, kf = Direction.forward(x, mask, w["fx"], w["fh"], w["fb"], learn)
        hb, kb = Direction.forward(x[::-1], mask[::-1], w["bx"], w["bh"], w["bb"], learn)
        top = np.concatenate([hf, hb[::-1], x], 2)[at, seq]
        return _sigmoid((top @ w["out"])[:, 0] + w["bias"]), (x, mask, kf, kb, top, at, seq)

    def predict(self, blocks, lens) -> np.ndarray:
        """The probability of each block of being main text."""
        return self._run(self._inputs(blocks), lens, learn=False)[0]

    def gradients(self, blocks, lens, label):
        p, (x, _, kf, kb, top, at, seq) = self._run(self._inputs(blocks), lens)
        w, g = self.w, {}
        d = ((p - label) / len(lens)).astype(np.float32)[:, None]
        g["out"], g["bias"] = top.T @ d, d.sum(0)
        dtop = d @ w["out"].T
        dhs = np.zeros((*x.shape[:2], 2 * HIDDEN), x.dtype)
        dhs[at, seq] = dtop[:, : 2 * HIDDEN]
        dxf, g["fx"], g["fh"], g["fb"] = Direction.backward(dhs[:, :, :HIDDEN], x, kf, w["fx"], w["fh"])
        dxb, g["bx"], g["bh"], g["bb"] = Direction.backward(dhs[::-1, :, HIDDEN:], x[::-1], kb, w["bx"], w["bh"])
        dx = (dxf + dxb[::-1])[at, seq] + dtop[:, 2 * HIDDEN :]
        for name, groups, part, mean in (("path", blocks[0], dx[:, :PATH_DIM], False), ("word", blocks[1], dx[:, PATH_DIM : PATH_DIM + WORD_DIM], True)):
            n = np.diff(groups[1])
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], groups[0], np.repeat(part / n.astype(part.dtype)[:, None] if mean else part, n, 0))
        return g


_CHROME = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "topbar", "links", "tabs"], "header": ["header", "masthead", "site-header", "top", "branding", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon", "legal"], "side": ["sidebar", "widget", "related", "aside", "side", "rail", "recommended", "popular"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "message", "paywall", "disclaimer"], "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sponsored", "ad-slot"],
    "form": ["form", "newsletter", "subscribe", "search", "login", "signup", "contact-form", "poll"], "comments": ["comments", "comment", "comment-list", "reply", "replies", "discussion", "responses", "thread", "respond"],
    "share": ["share", "social", "sharing", "tags", "pagination", "pager"],
}
_MAIN = ["content", "post", "entry", "article", "story", "main", "entry-content", "article-body", "post-content", "text", "page-content", "body-text"]
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"], "ad": ["div", "aside", "section", "ins"], "form": ["form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"]}


def drawn_page(rng: random.Random) -> list[tuple[str, bool | None]]:
    """Pieces of a page in turn: (markup, None) or (text, whether it is main text)."""
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "in", "or", "us", "el")]
    out: list[tuple[str, bool | None]] = []

    def words(a, b):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def tag(name, classes=()):
        own = [c for c in classes if c]
        how = rng.random()
        attr = "" if not own else f' class="{" ".join(own)}"' if how < 0.8 else f' id="{own[0]}"'
        out.append((f"<{name}{attr}>", None))

    def close(name):
        out.append((f"</{name}>", None))

    def leaf(name, a, b, main, link=False):
        tag(name)
        if link:
            tag("a")
        out.append((words(a, b), main))
        if link:
            close("a")
        if name != "p" or rng.random() < 0.9:
            close(name)

    def chrome(kind):
        name = rng.choice(_TAGS[kind])
        label = rng.choice(_CHROME[kind]) if name == "div" or name not in (kind, "aside", "nav", "header", "footer", "form") or rng.random() < 0.5 else ""
        tag(name, (label,))
        if kind in ("nav", "share") or kind == "side" and rng.random() < 0.5:
            if name not in ("ul", "ol"):
                tag("ul")
            for _ in range(rng.randint(2, 9)):
                leaf("li", 1, 4, False, True)
            if name not in ("ul", "ol"):
                close("ul")
        elif kind == "comments":
            if rng.random() < 0.5:
                leaf("h3", 1, 3, False)
            for _ in range(rng.randint(1, 6)):
                inner = "li" if name in ("ul", "ol") else rng.choice(["div", "article", "p"])
                if inner == "p":
                    leaf("p", 3, 60, False)
                    continue
                tag(inner, ("comment" if rng.random() < 0.7 else "",))
                if rng.random() < 0.5:
                    leaf(rng.choice(["span", "div", "b"]), 1, 3, False)
                leaf("p", 3, 60, False)
                close(inner)
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                leaf(rng.choice(["label", "p", "button", "h4", "div"]), 1, 20, False)
        else:
            if rng.random() < 0.4:
                out.append((words(2, 30), False))
            else:
                for _ in range(rng.randint(1, 4)):
                    leaf(rng.choice(["p", "div", "span", "h3", "h4", "h1"] if kind == "header" else ["p", "div", "p", "h3"]), 1, 40, False, rng.random() < 0.3)
        close(name)

    def some(kinds, share):
        for kind in rng.sample(kinds, len(kinds)):
            if rng.random() < share:
                chrome(kind)

    some(["header", "nav", "notice", "ad", "form"], 0.5)
    shell = rng.random() < 0.3
    if shell:
        tag("div", (rng.choice(["wrapper", "container", "page", "row", "layout", "site"]),))
    if rng.random() < 0.2:
        some(["side", "nav"], 0.6)
    bare = rng.random() < 0.12
    boxes = [] if bare else rng.choice([["article"], ["main"], ["div"], ["main", "article"], ["section"], ["article", "div"], ["article"], ["article"]])
    for name in boxes:
        tag(name, (rng.choice(_MAIN),) if name in ("div", "section") or rng.random() < 0.35 else ())
    if rng.random() < 0.8:
        head = rng.random() < 0.2
        if head:
            tag("header")
        leaf(rng.choice(["h1", "h1", "h2"]), 2, 14, True)
        if head:
            close("header")
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
        how = rng.random()
        if how < 0.75:
            leaf("p", 1, 120, True)
        elif how < 0.82:
            leaf(rng.choice(["h2", "h3", "blockquote", "pre", "figcaption"]), 1, 25, True)
        elif how < 0.88:
            kind = rng.choice(["ul", "ol"])
            tag(kind)
            for _ in range(rng.randint(1, 5)):
                leaf("li", 1, 25, True, rng.random() < 0.1)
            close(kind)
        elif how < 0.91:
            tag("table")
            for _ in range(rng.randint(1, 3)):
                tag("tr")
                leaf("td", 1, 6, True)
                leaf("td", 1, 6, True)
                close("tr")
            close("table")
        elif not bare:
            chrome(rng.choice(["ad", "side", "form", "notice", "share"]))
    if boxes and rng.random() < 0.15:
        chrome(rng.choice(["comments", "share"]))
    for name in reversed(boxes):
        close(name)
    some(["comments", "side", "share", "form", "ad", "notice"], 0.35)
    if shell:
        close("div")
    if rng.random() < 0.85:
        chrome("footer")
    return out


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """Weights from ``PAGES`` drawn pages: the same in every run, and of one size."""
    from cdsloom.llm.html_text import blocks_of, encoded

    rng = random.Random(SEED)
    pages = []
    for _ in range(PAGES):
        own, html, at = {}, "<html><body>", 0
        for piece, main in drawn_page(rng):
            if main is not None:
                # A marked word tells the block's label after parsing.
                piece, at = f"mark{at}x {piece}", at + 1
                own[piece.split()[0]] = main
            html += piece
        blocks = blocks_of(html)
        for b in blocks:
            first, _, rest = b.text.partition(" ")
            b.main, b.text = own[first], rest
        pages.append(blocks)
    model = Labeller()
    m, v = ({k: np.zeros_like(w) for k, w in model.w.items()} for _ in range(2))
    step, order = 0, np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        for at in np.array_split(order.permutation(len(pages)), len(pages) // BATCH):
            batch = [pages[k] for k in at if pages[k]]
            flat = [b for p in batch for b in p]
            g = model.gradients(encoded(flat), np.array([len(p) for p in batch]), np.array([b.main for b in flat], np.float32))
            step += 1
            rate = RATE * (1 if epoch < EPOCHS - 2 else 0.3)
            for k, w in model.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return model.w
