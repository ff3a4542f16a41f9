"""Tokens of each section of a text, by their offsets.

A document is encoded once, whole.  The spans of its tokens are joined to the
intervals of its sections.  Rule for a token that crosses a boundary: it counts
for the section that holds its first code point, and n_crossing says how many
tokens of a section run on into later ones.  So sections add up to the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cdsloom.llm.byte_bpe import SLICE_BYTES, ByteEncoder
from cdsloom.llm.common import slices, texts


def lines(data: np.ndarray) -> np.ndarray:
    """Where each line of UTF-8 bytes starts; a line holds the line feed that ends it."""
    starts = np.r_[0, np.flatnonzero(data == 10) + 1]
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(data) else starts


def attributed(docs: DataFrame, *, vocabulary: str, sections: Callable[[np.ndarray], np.ndarray] = lines, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section (from 0), start, end (code points), n_tokens, n_crossing: a row per section.

    ``sections`` gives the ascending byte offsets, from 0 on, at which the
    sections of a text start.  A null or empty text is one empty section.  Rows
    that share a doc_id are documents of their own; no rows give no sections.
    Texts are encoded whole, whatever their length; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(vocabulary)
        for b in slices(batches, most=SLICE_BYTES):
            text_ = pc.fill_null(b.column("text"), "")
            ids, ptr = encoder.encode(text_)
            size = encoder.piece_bytes[ids]
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for k in range(len(text_)):
                data = np.frombuffer(text_[k].as_buffer(), np.uint8)
                starts = sections(data)
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                ends = np.cumsum(size[ptr[k] : ptr[k + 1]])
                if len(ends) and ends[-1] != len(data):
                    raise ValueError("tokens don't cover their text")
                # A token that starts inside a code point starts with that code point.
                char = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)) if len(data) else data
                first = np.searchsorted(starts, char[ends - size[ptr[k] : ptr[k + 1]]], "right") - 1
                last = np.searchsorted(starts, ends - 1, "right") - 1
                n = len(starts)
                bounds = points[np.r_[starts, len(data)]]
                for c, x in zip(columns, (np.full(n, k), np.arange(n), bounds[:-1], bounds[1:], np.bincount(first, minlength=n), np.bincount(first[last > first], minlength=n)), strict=True):
                    c.append(x)
            doc, *rest = (np.concatenate(c).astype(np.int64) for c in columns)
            yield pa.record_batch([b.column("doc_id").take(pa.array(doc)), *map(pa.array, rest)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return texts(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
