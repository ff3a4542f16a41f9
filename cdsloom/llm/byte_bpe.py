"""Byte-level BPE: ids of whole texts through tables of distinct words, and back through a table of pieces.

A text is split into words (each with the space before it), every distinct
word of a slice is looked up once, only words that a worker hasn't seen lately
go through the library, and ids return to their places by position.  The table
of distinct words belongs to a slice, so that nothing is shuffled.  Decoding
joins ids to the pieces of the vocabulary, a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cdsloom.llm.common import binary_column, csr, no_workers_pool, slices, texts
from cdsloom.llm.encoders import Recent

SLICE_BYTES = 4 << 20
_W = " \t\n\v\f\r"
#: White space beyond ASCII, and controls that libraries take for it: such texts go through the library whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORDS = re.compile(rf" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: How the vocabulary cuts words: fixed.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BATCH = 20_000
#: Characters of words that keep their ids when many are encoded in one string.
_JOINS = re.compile("[\n -~¡-¬®-ɏ]*").fullmatch

_loaded: dict[str, ByteEncoder] = {}


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteEncoder:
    """Ids below 65536 of texts, as the library gives them without special tokens added, and their pieces."""

    def __init__(self, path: str):
        no_workers_pool()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 1 << 16:
            raise ValueError(f"{path}: ids of more than 16 bits")
        added = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = tuple(added.values())
        of_byte = byte_characters()
        self.pieces = [b""] * size
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[k] = added[k].encode() if k in added else bytes(of_byte[c] for c in token)
        self.piece_bytes = np.array([len(p) for p in self.pieces], np.int64)
        ranks = {p: k for k, p in enumerate(self.pieces) if k not in added}
        #: The same vocabulary in a faster library; words of few alphabets go through it.
        self.plain = tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = Recent()

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of words, each with a space before it, that are alike when many are encoded in one string."""
        names = pa.array(words)
        ids = np.array(self.plain.encode_ordinary(" " + " ".join(words)), "<u2")
        ends, wanted = np.cumsum(self.piece_bytes[ids]), np.cumsum(pc.binary_length(names).to_numpy().astype(np.int64) + 1)
        cut = np.searchsorted(ends, wanted)
        if (ends[cut] != wanted).any():
            raise ValueError("words and tokens don't end together")
        data, at = ids.tobytes(), [0, *(2 * (cut + 1)).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, a space before it, in little-endian 16 bits; words have no white space at either end."""
        found = self.spaced.get_all(words)
        missing = [k for k, x in enumerate(found) if x is None]
        for at in range(0, len(missing), _BATCH):
            part = missing[at : at + _BATCH]
            names = [words[k] for k in part]
            got = self._joined(names) if _JOINS(" ".join(names)) else None
            if got is None:
                plain = [w for w in names if _JOINS(w)]
                known = dict(zip(plain, self._joined(plain), strict=True)) if plain else {}
                others = [w for w in names if w not in known]
                known.update(zip(others, self._library([" " + w for w in others]), strict=True))
                got = [known[w] for w in names]
            for k, x in zip(part, got, strict=True):
                found[k] = x
            self.spaced.put_all(names, got)
        return found

    def _odd(self, text: str) -> bool:
        return bool(_ODD.search(text)) or any(s in text for s in self.special)

    def _one(self, text: str) -> bytes:
        if self._odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        words = _WORDS.findall(text)
        known = list(set(words))
        spaced = [w for w in known if w[0] == " " and len(w) > 1 and w[1] not in _W]
        ids = dict(zip(spaced, self.of_words([w[1:] for w in spaced]), strict=True))
        others = [w for w in known if w not in ids]
        ids.update(zip(others, self._library(others), strict=True))
        return b"".join(map(ids.__getitem__, words))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids start (one more entry than texts)."""
        lists = pc.split_pattern(text, " ")
        d = lists.flatten().dictionary_encode()
        idx, ptr = d.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        ptr = ptr - ptr[0]
        names = d.dictionary
        # Pieces without text, or with white space at an end, stand in texts that are split in full.
        at = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, 4 * names.offset)
        data = np.frombuffer(names.buffers()[2] or b"\0", np.uint8)
        size = np.diff(at)
        space = np.zeros(256, bool)
        space[[ord(c) for c in _W]] = True
        bad = (size == 0) | space[data[np.minimum(at[:-1], len(data) - 1)]] | space[data[np.maximum(at[1:] - 1, 0)]]
        uniq = names.to_pylist()
        if self._odd("\n".join(uniq)):
            bad |= np.array([self._odd(u) for u in uniq], bool)
        row = np.repeat(np.arange(len(text)), np.diff(ptr))
        apart = np.zeros(len(text), bool)
        apart[row[bad[idx]]] = True
        first = ptr[:-1]
        lead, lead_at = np.unique(idx[first], return_inverse=True)
        pool = self.of_words(names.filter(pa.array(~bad)).to_pylist() if bad.any() else uniq)
        n = len(pool)
        idx = (np.cumsum(~bad) - 1)[idx]
        good = [uniq[k] for k in lead if not bad[k]]
        ids = dict(zip(good, self._library(good), strict=True))
        pool += [ids.get(uniq[k], b"") for k in lead]
        idx[first] = n + lead_at
        whole = np.flatnonzero(apart)
        idx[first[whole]] = len(pool) + np.arange(len(whole))
        pool += [self._one(x) for x in text.take(pa.array(whole)).to_pylist()]
        keep = ~apart[row]
        keep[first] = True
        lens = np.fromiter(map(len, pool), np.int64, len(pool)) // 2
        places, ends = csr(lens, idx[keep])
        return np.frombuffer(b"".join(pool), "<u2")[places], ends[np.r_[0, np.cumsum(keep)][ptr]]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = ByteEncoder.of(path)
    for b in slices(batches, most=SLICE_BYTES):
        ids, ptr = encoder.encode(pc.fill_null(b.column("text"), ""))
        yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(ptr)), binary_column(ids, ptr, 2)], ["doc_id", "n_tokens", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = ByteEncoder.of(path)
    for b in batches:
        text = [encoder.decode(np.frombuffer(x.as_buffer(), "<u2")) for x in b.column("ids")]
        yield pa.record_batch([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])


def encoded(docs: DataFrame, *, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 16-bit): a row per row of ``docs``, repeated rows too.

    A null or empty text has no ids; a very long one is encoded whole, in a slice
    of its own; an empty table gives no rows; other columns are not read.
    """
    return texts(docs, doc_id=doc_id, text=text).mapInArrow(lambda b: encode_batches(b, vocabulary), "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, *, vocabulary: str) -> DataFrame:
    """The rows of encoded() with their text; special tokens are decoded too."""
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(lambda b: decode_batches(b, vocabulary), "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, digest, fields: str, *, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``digest`` makes of the batches of decoded(encoded()), in one worker per task; the same rows and cases as encoded()."""
    return texts(docs, doc_id=doc_id, text=text).mapInArrow(lambda b: digest(decode_batches(encode_batches(b, vocabulary), vocabulary)), fields)
