"""Token ids of whole texts from the tokenizers library, each distinct word of a slice encoded once.

The vocabulary with word ends drops white space and never merges across it, so
a text's ids are the ids of its white-space separated words in turn.  Words are
found by Arrow, distinct ones of a slice looked up in a bounded cache, and only
the missing ones go through the library, many at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cdsloom.llm.common import Words, csr, no_workers_pool

#: Distinct words that a worker remembers, of so many bytes in all; in Recent in each of two generations, and no longer words.
CACHED_WORDS, CACHED_BYTES, CACHED_CHARS = 150_000, 16 << 20, 64
_JOINED_CHARS = 1 << 17

#: Bytes of text to encode at once.
SLICE_BYTES = 6 << 20

#: A word of Latin-1 letters and the ASCII punctuation after it.  Such letters
#: are composed already and have lower case one by one, the two parts are
#: always tokenized apart, and no special token looks like that.
_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"

_loaded: dict[str, WordEncoder] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(words: list[str]):
    """Groups of words of a bounded length in all."""
    group, chars = [], 0
    for w in words:
        group.append(w)
        chars += len(w) + 1
        if chars >= _JOINED_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


class Recent:
    """Remembers what was used lately: two generations of bounded size."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get_all(self, words: list[str]) -> list:
        found = list(map(self.young.get, words))
        for k in [k for k, x in enumerate(found) if x is None] if self.old else ():
            if (x := self.old.get(words[k])) is not None:
                found[k] = x
                self.put(words[k], x)
        return found

    def put_all(self, words: list[str], values: list) -> None:
        if len(self.young) >= CACHED_WORDS:
            self.young, self.old = {}, self.young
        self.young.update((w, x) for w, x in zip(words, values, strict=True) if len(w) <= CACHED_CHARS)

    def put(self, word: str, value) -> None:
        if len(word) <= CACHED_CHARS:
            if len(self.young) >= CACHED_WORDS:
                self.young, self.old = {}, self.young
            self.young[word] = value


class Known:
    """The ids of distinct strings, remembered up to a bound: then those of the last call stay."""

    def __init__(self, encode):
        self.encode = encode
        self._keep(pa.array([""]), np.zeros(0, "<u2"), np.zeros(1, np.int64))

    def _keep(self, names: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.names, self.ids, self.lens = names, ids, lens

    def places(self, names: pa.Array) -> np.ndarray:
        """Places of ``names`` in the table, which is extended by those that it hasn't."""
        if len(self.names) > CACHED_WORDS or self.names.nbytes > CACHED_BYTES:
            self.__init__(self.encode)
        at = pc.index_in(names, value_set=self.names)
        new = names.filter(at.is_null())
        old = len(self.names)
        if len(new):
            ids, lens = self.encode(new.to_pylist())
            self._keep(pa.concat_arrays([self.names, new]), np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens]))
        out = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        out[out < 0] = old + np.arange(len(new))
        return out


class WordEncoder:
    """Ids below 65536 of texts, for a vocabulary with word ends that drops white space."""

    def __init__(self, path: str):
        no_workers_pool()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError(f"{path}: ids of more than 16 bits")
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(1 << 16, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[k] = token.endswith(suffix)
        self.parts, self.others = Known(self._encode_plain), Known(self._encode_any)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    @staticmethod
    def forget() -> None:
        """Free the workers' encoders, for a stage that doesn't need them."""
        _loaded.clear()

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words in lower case that are one piece each, and how many each has."""
        found = [e.ids for e in self.plain.encode_batch_fast([" ".join(group) for group in _joined(words)], add_special_tokens=False)]
        ids = np.concatenate([np.array(x, "<u2") for x in found])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("words and word ends differ")
        return ids, np.diff(ends, prepend=0)

    def _encode_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words."""
        ids, lens = [], []
        for group in _joined(words):
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ids.append(np.array(e.ids, "<u2"))
            starts = np.cumsum([0, *(len(w) + 1 for w in group)])
            lens.append(np.diff(np.searchsorted(np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], starts)))
        return np.concatenate(ids), np.concatenate(lens)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words in one array, and how many each has."""
        split = pc.extract_regex(words, _PLAIN)
        is_plain = split.is_valid()
        plain = is_plain.to_numpy(zero_copy_only=False)
        core, tail = (x.filter(is_plain).dictionary_encode() for x in (pc.utf8_lower(pc.struct_field(split, "core")), pc.struct_field(split, "tail")))
        places = self.parts.places(pa.concat_arrays([core.dictionary, tail.dictionary]))
        others = self.others.places(words.filter(pc.invert(is_plain)))
        # A word is two strings: what stands before the punctuation at its end, and that; place 0 is the empty string.
        two = np.zeros((len(words), 2), np.int64)
        two[plain, 0] = places[core.indices.to_numpy()]
        two[plain, 1] = places[len(core.dictionary) :][tail.indices.to_numpy()]
        two[~plain, 0] = len(self.parts.lens) + others
        lens = np.concatenate([self.parts.lens, self.others.lens])
        at, ends = csr(lens, two.ravel())
        return np.concatenate([self.parts.ids, self.others.ids])[at], np.diff(ends[::2])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids start (one more entry than texts)."""
        w = Words(text)
        ids, lens = self.of_words(w.uniq)
        places, at = csr(lens, w.idx)
        return ids[places], at[w.ptr]


def with_end(ids: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    out = np.insert(ids, ptr[1:], np.asarray(end, ids.dtype))
    return out, ptr + np.arange(len(ptr))
