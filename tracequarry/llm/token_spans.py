"""Token counts of sections, from one encoding of the whole document.

A text is encoded once, so tokens are those a model would see; each token keeps the span of characters that
its bytes touch. The spans are joined to the sections' spans, both in order, by binary search. A token that
touches several sections is counted once, by rule:

- "majority": in the section of which it touches most characters, the first of them in a tie;
- "start": in the section of its first character; "end": in that of its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracequarry.llm._text import slices, text_buffer
from tracequarry.llm.byte_bpe import codec, no_collection

RULES = ("majority", "start", "end")


def owners(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether the token crosses a boundary.

    bounds: ends of the sections in order; section k covers [bounds[k - 1], bounds[k]). Spans have a character at least.
    """
    first, last = np.searchsorted(bounds, starts, side="right"), np.searchsorted(bounds, ends - 1, side="right")
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    owner = first.copy()
    for i in np.flatnonzero(crossing):
        edges = np.concatenate(([starts[i]], bounds[first[i] : last[i]], [ends[i]]))
        owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return owner, crossing


def attribute_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "majority", scale: float = 1.0) -> DataFrame:
    """Count tokens of each section of each whole text; sections end after the separator (one ASCII character).

    Returns one row per section: id_col, section int (from 0), start_char, end_char (code points, end exclusive,
    the separator included), n_tokens long and n_crossing long (those of its tokens that also touch another
    section). A text that ends with the separator has an empty last section. A null or empty text has one empty
    section. Repeated rows and null ids each give their own rows. The sections' n_tokens sum to the document's. scale: as of encode_documents().
    One pass without a shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    mark, kind = ord(separator), dict(docs.dtypes)[id_col]
    if mark > 127:
        raise ValueError("the separator must be an ASCII character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, pattern, scale)
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                raw = data[offsets[lo] : offsets[hi]]
                # All texts of a slice stand in one line of characters; sections end at marks and at ends of texts.
                char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
                text_at = np.append(char_of, char_of[-1] + 1 if len(raw) else 0)[at]
                with no_collection():
                    ids = np.frombuffer(b"".join(made.encode(raw[at[k] : at[k + 1]].tobytes().decode()) for k in range(hi - lo)), "<u4")
                ends = np.cumsum(made.length_of[ids])
                first, last = char_of[ends - made.length_of[ids]], char_of[ends - 1] + 1
                marks = char_of[np.flatnonzero(raw == mark)] + 1
                # A mark at the end of a text leaves an empty section after it: both bounds stay.
                text_of_mark = np.searchsorted(text_at[1:], marks, side="left")
                bounds = np.concatenate((marks, text_at[1:]))
                text_of = np.concatenate((text_of_mark, np.arange(hi - lo)))
                order = np.lexsort((np.concatenate((np.zeros(len(marks), int), np.ones(hi - lo, int))), bounds, text_of))
                bounds, text_of = bounds[order], text_of[order]
                begins = np.concatenate(([0], bounds[:-1]))
                owner, crossing = owners(first, last, bounds, rule)
                number = np.arange(len(bounds)) - np.searchsorted(text_of, text_of, side="left")
                base = text_at[text_of]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(text_of)), pa.array(number.astype(np.int32)), pa.array(begins - base), pa.array(bounds - base),
                        pa.array(np.bincount(owner, minlength=len(bounds))), pa.array(np.bincount(owner[crossing], minlength=len(bounds))),
                    ],
                    names=[id_col, "section", "start_char", "end_char", "n_tokens", "n_crossing"],
                )

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, section int, start_char long, end_char long, n_tokens long, n_crossing long")
