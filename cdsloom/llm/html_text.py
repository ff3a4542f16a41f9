"""Main text of web pages: a page is cut into blocks of text, and a recurrent labeller says which are the article's.

Blocks end where block tags begin and end.  Scripts, styles, titles, comments
in the markup and the like never make blocks.  The labeller reads all blocks of
a page, forwards and backwards, and so judges each in its surroundings.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdsloom.llm.common import hash_words, slices
from cdsloom.llm.pages_model import NUMBERS, PATHS, WORDS, Block, Labeller, trained

SLICE_BYTES = 1 << 20
#: Blocks of one run of the labeller over pages of like length; a longer page is a run of its own.
RUN_BLOCKS = 4096

#: Elements whose content is no text, tags that end a block, and tags without an end: fixed values.
_RAW = frozenset("script style title textarea noscript template iframe svg select canvas".split())
_BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html ins legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption label xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these before it, up to the nearest of the second kind.
_ENDS = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"})}
_SCOPE = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>(?>[^<>"']+|"[^"]*"|'[^']*')*+)>""", re.S | re.I)
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in (*_RAW, "xmp")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


def _tokens(tag: str, attr: str) -> tuple[str, ...]:
    """Tokens of one element of a path: its tag, and the words of its class, id and role."""
    if not attr:
        return (tag,)
    names = {x for m in _NAMES.finditer(attr) for x in _PART.findall((m[1] or m[2] or m[3] or "").lower())}
    return (tag, *("." + x for x in sorted(names)))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, references decoded, white space as single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    opened: Counter[str] = Counter()

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), len("".join(linked).split())))
            parts.clear()
            linked.clear()

    def pop(k: int) -> None:
        """Close all elements from place k of the stack on."""
        nonlocal links
        for t, _ in stack[k:]:
            opened[t] -= 1
            links -= t == "a"
        del stack[k:]

    at = 0
    endless: set[str] = set()

    def close(tag: str) -> re.Match | None:
        """The next end tag; a page is searched in vain once for each name."""
        found = None if tag in endless else _CLOSE[tag].search(page, at)
        if not found:
            endless.add(tag)
        return found

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked.append(parts[-1])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in _RAW:
            if m["end"] or tag == "svg" and m["attr"].rstrip().endswith("/"):
                continue
            # Scripts and styles without an end go on to the page's; what follows other such tags is read.
            if end := close(tag):
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
                linked.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if m["end"]:
            # An end tag of nothing open is passed over without a search.
            if opened[tag]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        ends = _ENDS.get(tag, _ENDS["p"] if tag in _BLOCK else frozenset())
        k = len(stack) - 1
        while k >= 0 and stack[k][0] not in _SCOPE and any(opened[t] for t in ends):
            # A row ends the cell in it, an item the paragraph in it.
            if stack[k][0] in ends:
                pop(k)
            k -= 1
        if not m["attr"].rstrip().endswith("/"):
            above = stack[-1][1] if stack else ()
            new = tuple(t for t in _tokens("pre" if tag == "xmp" else tag, m["attr"]) if t not in above and t not in ("html", "body"))
            stack.append((tag, above + new))
            opened[tag] += 1
            links += tag == "a"
        if tag == "xmp" and (end := close(tag)):
            # Tags and references in it are text.
            parts.append(html.escape(page[at : end.start()]))
            at = end.start()
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_place: dict[str, int] = {}


def _path(tokens: tuple[str, ...]) -> np.ndarray:
    """Places of the path's tokens, and of its last new tag once more."""
    for t in tokens:
        if t not in _place and len(_place) < 50_000:
            _place[t] = zlib.crc32(t.encode()) % PATHS
    out = [_place.get(t, zlib.crc32(t.encode()) % PATHS) for t in tokens]
    inner = next((t for t in reversed(tokens) if t[0] != "."), "")
    return np.array([*out, zlib.crc32(b">" + inner.encode()) % PATHS], np.int64)


def _words(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all blocks' words, by a hash of the whole word in lower case, and where each block starts."""
    lists = pc.split_pattern(pc.utf8_lower(pa.array([b.text for b in blocks])), " ")
    words = lists.flatten().dictionary_encode()
    places = (hash_words(words.dictionary.to_pylist()) % np.uint64(WORDS)).astype(np.int64)
    return places[words.indices.to_numpy()], lists.offsets.to_numpy().astype(np.int64)


def encoded(blocks: list[Block]):
    """What the labeller reads of each block: places of path tokens, places of words, numbers."""
    words = _words(blocks)
    known: dict[tuple[str, ...], np.ndarray] = {}
    paths = []
    for b in blocks:
        if b.path not in known:
            known[b.path] = _path(b.path)
        paths.append(known[b.path])
    n = np.diff(words[1]).astype(np.float32)
    numbers = np.zeros((len(blocks), NUMBERS), np.float32)
    numbers[:, 0] = np.log1p(n) / 4
    numbers[:, 1] = np.array([b.linked for b in blocks]) / np.maximum(n, 1)
    numbers[:, 2] = [b.text[-1:] in ".!?:;" for b in blocks]
    return (np.concatenate(paths), np.r_[0, np.cumsum([len(x) for x in paths])]), words, numbers


def main_texts(model: Labeller, pages: list[str], least: float = 0.5) -> list[str]:
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    run: list[int] = []
    for k in sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k])):
        if run and len(parsed[k]) * (len(run) + 1) > RUN_BLOCKS:
            _label(model, parsed, run, out, least)
            run = []
        run.append(k)
    if run:
        _label(model, parsed, run, out, least)
    return out


def _label(model: Labeller, parsed: list[list[Block]], run: list[int], out: list[str], least: float) -> None:
    lens = np.array([len(parsed[k]) for k in run])
    keep = model.predict(encoded([b for k in run for b in parsed[k]]), lens) >= least
    at = 0
    for k, n in zip(run, lens.tolist(), strict=True):
        out[k] = "\n".join(b.text for b, good in zip(parsed[k], keep[at : at + n].tolist(), strict=True) if good)
        at += n


def extracted(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): a row per row of ``pages``.

    A null or empty page, and one without main text, has an empty text.  Whole
    pages are read whatever their length; rows with one page_id are pages of
    their own; an empty table gives no rows; other columns are not read.
    """
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(weights)
        for b in slices(batches, "html", SLICE_BYTES):
            text = pa.array(main_texts(model, pc.fill_null(b.column("html"), "").to_pylist()), pa.string())
            yield pa.record_batch([b.column("page_id"), b.column("url"), text, pc.utf8_length(text).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
