"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words are [^\\x20\\x09-\\x0D]+. Each word and each pair of neighbouring words of a text is hashed to one of a
fixed number of buckets. Two multinomials over the buckets are counted, one over all documents and one over
the trusted ones; a document's score is the mean over its n-grams of the log of the ratio of the two, so
length does not move it. Documents at or above a fixed threshold are kept, unless a base rule fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._text import SPACE, Prefix, mix, per_text, row_ids, shingles, slices, text_buffer, words
from tracequarry.plans.shared import materialise

BUCKETS = 1 << 16  # of words, and as many again of pairs
#: Mean log ratio (nats an n-gram) below which a document goes.
THRESHOLD = -0.27
#: Whole-number ids of trusted documents are broadcast, 64 to a number, up to so many numbers (32 MB).
MARKED = 1 << 21
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and pairs, the text of each, the words' hashes and ranges."""
    starts, ends, first = words(data, offsets)
    hashes = Prefix(data).of(starts, ends)
    pairs, at = shingles(hashes, first, 2)
    text_of = row_ids(np.diff(first))
    mask = np.uint64(BUCKETS - 1)
    buckets = np.concatenate(((hashes & mask).astype(np.int64), (pairs & mask).astype(np.int64) + BUCKETS))
    return buckets, np.concatenate((text_of, text_of[at])), hashes, first


def base_counts(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text in the buffer."""
    inside, n = ~SPACE[data], len(offsets) - 1
    n_words = np.diff(first)
    # Lines: the ends of texts and the line feeds; equal lines of a text have equal keys.
    feeds = np.flatnonzero(data == 0x0A)
    text_of = np.concatenate((np.searchsorted(offsets, feeds, side="right") - 1, np.arange(n)))
    ends = np.concatenate((feeds, offsets[1:]))
    order = np.lexsort((ends, text_of))
    text_of, ends = text_of[order], ends[order]
    begins = np.empty_like(ends)
    begins[1:] = ends[:-1] + 1
    new = np.ones(len(ends), bool)
    new[1:] = text_of[1:] != text_of[:-1]
    begins[new] = offsets[text_of[new]]
    sums = np.concatenate(([0], np.cumsum(inside)))
    held = sums[ends] > sums[begins]
    line_texts = text_of[held]
    lines = np.bincount(line_texts, minlength=n)
    whole = mix(Prefix(data).of(begins[held], ends[held]) + mix(line_texts.astype(np.uint64)))
    _, one = np.unique(whole, return_index=True)
    different = np.bincount(line_texts[one], minlength=n)
    # Windows: equal windows of a text have equal keys; every word under one that recurs is marked.
    windows, at = shingles(hashes, first, WINDOW)
    word_text = row_ids(n_words)
    keys = windows + mix(word_text[at].astype(np.uint64))
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": n_words,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": lines - different,
        "n_repeat_words": per_text(repeated, first),
    }


def _counts(texts: DataFrame) -> DataFrame:
    """bucket and n over all texts (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            offsets, data = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                buckets, *_ = _grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total += np.bincount(buckets, minlength=2 * BUCKETS)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 10_000):
            at = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _trusted_texts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, marked: int) -> DataFrame:
    """The texts (one column) of the rows whose id is in trusted."""
    text = docs[text_col].cast("string").alias("__text")
    whole = {"tinyint", "smallint", "int", "bigint"}
    if dict(docs.dtypes)[id_col] in whole and dict(trusted.dtypes)[id_col] in whole:
        bits = trusted.select(F.col(id_col).cast("long").alias("i")).dropna().groupBy(F.expr("shiftright(i, 6)").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63L AS int))")).alias("__bits"))
        # Stored, so its size is known before it is broadcast.
        bits = materialise(bits, "trusted_ids")
        if bits.count() <= marked:
            rows = docs.select(F.col(id_col).cast("long").alias("__key"), text).withColumn("__place", F.expr("shiftright(__key, 6)"))
            return rows.join(F.broadcast(bits), F.col("__place") == F.col("__word")).where(F.expr("shiftright(__bits, cast(__key & 63L AS int)) & 1L") == 1).select("__text")
    ids = trusted.select(F.col(id_col).alias("__id")).dropna().distinct()
    return docs.select(F.col(id_col).alias("__key"), text).join(ids, F.col("__key") == F.col("__id"), "left_semi").select("__text")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: int = MARKED) -> np.ndarray:
    """log(target / raw) of every bucket, both smoothed by one count a bucket.

    trusted: a table with id_col, of documents known to be good; all of them count for the target, and all documents
    for the raw law. What reaches the driver is one row a bucket and law. Whole-number ids are broadcast as bits, up
    to `marked` numbers; beyond that, and for other ids that the planner does not find small, texts move by a shuffle.
    """
    text = docs[text_col].cast("string").alias("__text")
    good = _trusted_texts(docs, trusted, id_col, text_col, marked)
    both = _counts(docs.select(text)).select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target")).unionByName(_counts(good).select("bucket", F.lit(0).cast("long").alias("raw"), F.col("n").alias("target")))
    found = both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(2 * BUCKETS), np.ones(2 * BUCKETS)
    at = found["bucket"].to_numpy(np.int64)
    raw[at] += found["raw"].to_numpy(float)
    target[at] += found["target"].to_numpy(float)
    out = np.empty(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        # Nothing trusted, nothing known: the ratio is 1 and the base rules alone decide.
        out[half] = np.log(target[half] / target[half].sum()) - np.log(raw[half] / raw[half].sum()) if target[half].sum() > BUCKETS else 0.0
    return out


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, length-normalised log-likelihood ratio and verdict of every whole text.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (fewer than
    10 words, or over 20 % of the words in repeated 5-word windows), llr double (0 for a text without words) and
    kept (base passed and llr at or above the threshold). A null text counts as empty and fails the base; a null
    id is never trusted. Every row gives one row, repeated rows too; other columns are ignored.
    Very long texts are handled alone, in memory of some twenty times their length. Three passes over the texts (one
    of them over the trusted), all but the last reduced to one row a bucket; no text is shuffled up to the bound in log_ratios.
    """
    kind = dict(docs.dtypes)[id_col]
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted, id_col, text_col).astype(np.float32))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                at, raw = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                buckets, text_of, hashes, first = _grams(raw, at)
                counts = base_counts(raw, at, hashes, first)
                n = np.bincount(text_of, minlength=hi - lo)
                llr = np.bincount(text_of, ratios.value[buckets].astype(float), minlength=hi - lo) / np.maximum(n, 1)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(counts[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *names, "base_failed", "llr", "kept"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, llr double, kept boolean"
    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(score, schema)
