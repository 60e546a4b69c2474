"""Language identification by unigrams over pieces, summed over all segmentations.

The vocabulary is a fixed public one: pieces that begin a word (marked U+2581 there), inner pieces, and one
piece a byte as a fall-back, so every word has a segmentation. Each language has a probability for each piece.
A word's probability is the sum over all its segmentations of the product of its pieces' probabilities,
found by the forward algorithm; a text's is the product over its words ([^\\x20\\x09-\\x0D]+). Words of many
texts are handled together: positions in turn, all words at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._sample import lowest_hash
from tracequarry.llm._text import Prefix, lean, resident, row_ids, slices, text_buffer, words
from tracequarry.plans.shared import materialise

START = "▁"
#: The fit reads at most so many labelled documents a language, those of lowest hash of their id, and all words of theirs.
SAMPLE_ROWS = 1500
ROUNDS = 3  # of expectation and maximisation
SMOOTHING = 0.02  # share of each language's mass that follows all languages and the uniform law
LONGEST = 32  # bytes; longer words are scored one at a time, and cut for the fit
LIFT = 3.0  # log of the factor a byte that keeps products of many small numbers in range
KNOWN_WORDS = 400_000  # words whose scores a worker keeps
SCORED_BYTES = 1 << 19  # of text scored at once; a longer text comes alone
UNKNOWN = "und"


class Vocabulary:
    """A trie over the pieces' bytes. Piece 0..V-1: word beginnings and inner pieces; the last 256: single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.size = len(found) + 256
        self.bytes0 = len(found)
        self.empty = self.size  # a place for "the mark alone" if the vocabulary lacks it
        inner: dict[bytes, int] = {}
        initial: dict[bytes, int] = {}
        for i, piece in enumerate(found):
            if piece.startswith(START):
                initial[piece[1:].encode()] = i
            else:
                inner[piece.encode()] = i
        self.empty = initial.pop(b"", self.bytes0)  # the mark alone: a word begins with an inner piece
        self.tables = [self._trie(initial), self._trie(inner)]
        self.length = np.ones(self.size)
        for d in (initial, inner):
            for piece, i in d.items():
                self.length[i] = len(piece)
        self.length[self.empty] = 0

    @staticmethod
    def _trie(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Dense steps of the nodes that have children (0: none), and the piece that ends at each node (-1: none)."""
        prefixes = {p[:k] for p in pieces for k in range(len(p) + 1)} | {b""}
        parents = {p[:-1] for p in prefixes if p}
        order = [b"", *sorted(parents - {b""}), *sorted(prefixes - parents - {b""})]
        number = {p: i for i, p in enumerate(order)}
        steps = np.zeros((max(1, len(parents)), 256), np.int32)
        for p in order[1:]:
            steps[number[p[:-1]], p[-1]] = number[p]
        return steps, np.array([pieces.get(p, -1) for p in order], np.int32)


class Lattice:
    """The pieces that fit a set of words, position by position. Words: uint8 (n, longest), lengths falling; begins: whether they are whole words or go on one."""

    def __init__(self, vocabulary: Vocabulary, chars: np.ndarray, lengths: np.ndarray, begins: bool = True):
        self.vocabulary, self.lengths, self.begins = vocabulary, lengths, begins
        self.longest = int(lengths[0]) if len(lengths) else 0
        self.hits: list[tuple[int, int, np.ndarray, np.ndarray, bool]] = []  # start, end, words, pieces, begins the word
        for start in range(self.longest):
            alive = int(np.searchsorted(-lengths, -start, side="left"))  # words longer than start
            self.hits.append((start, start + 1, np.arange(alive), vocabulary.bytes0 + chars[:alive, start].astype(np.int64), False))
            for which in (0, 1) if start == 0 and begins else (1,):
                steps, piece_at = vocabulary.tables[which]
                rows, node, at = np.arange(alive), np.zeros(alive, np.int32), start
                while len(rows) and at < self.longest:
                    on = lengths[rows] > at
                    rows, node = rows[on], node[on]
                    node = steps[node, chars[rows, at]]
                    on = node > 0
                    rows, node, at = rows[on], node[on], at + 1
                    piece = piece_at[node]
                    fits = piece >= 0
                    if fits.any():
                        self.hits.append((start, at, rows[fits], piece[fits].astype(np.int64), which == 0))
                    on = node < len(steps)
                    rows, node = rows[on], node[on]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each prefix: (n, longest + 1, languages). p: (pieces, languages)."""
        alpha = np.zeros((len(self.lengths), self.longest + 1, p.shape[1]))
        alpha[:, 0] = p[self.vocabulary.empty] if self.begins else 1.0
        for start, end, rows, pieces, first in self.hits:
            alpha[rows, end] += p[pieces] if first else alpha[rows, start] * p[pieces]
        return alpha

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under p (pieces, 1), words weighted."""
        n, rows_all = len(self.lengths), np.arange(len(self.lengths))
        alpha = self.forward(p)[:, :, 0]
        total = alpha[rows_all, self.lengths]
        beta = np.zeros((n, self.longest + 1))
        beta[rows_all, self.lengths] = weight / total
        uses, p1 = np.zeros(self.vocabulary.size), p[:, 0]
        for start, end, rows, pieces, first in reversed(self.hits):
            share = p1[pieces] * beta[rows, end]
            if not first:
                beta[rows, start] += share
                share = share * alpha[rows, start]
            uses += np.bincount(pieces, share, minlength=len(uses))
        if self.begins:
            uses[self.vocabulary.empty] += float((beta[:, 0] * p1[self.vocabulary.empty]).sum())
        return uses


def grid(found: list[bytes]) -> np.ndarray:
    """Words as rows of bytes, zero-filled."""
    width = max(map(len, found), default=1)
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in found), np.uint8).reshape(len(found), width)


def cut(word: bytes) -> list[bytes]:
    """A word in parts of at most LONGEST bytes, at the bounds of characters."""
    out, at = [], 0
    while at < len(word):
        end = min(at + LONGEST, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return out


def expected_uses(vocabulary: Vocabulary, parts: dict[tuple[bool, bytes], int], p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the counted parts of words (does it begin a word, bytes), some thousands at a time."""
    uses = np.zeros(vocabulary.size)
    for begins in (True, False):
        found = sorted((w for b, w in parts if b is begins), key=lambda w: (-len(w), w))
        for k in range(0, len(found), 4096):
            some = found[k : k + 4096]
            lattice = Lattice(vocabulary, grid(some), np.array([len(w) for w in some], np.int64), begins)
            uses += lattice.expected(p, np.array([parts[begins, w] for w in some], float))
    return uses


def fit(path: str, counted: DataFrame, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the pieces' probabilities (pieces, languages) from stored word counts (lang, w, count).

    Expectations are taken where the words are; the driver gets a number a piece and language each round.
    """
    vocabulary, spark = vocabulary_of(path), counted.sparkSession
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((vocabulary.size, 0))
    lift = np.exp(LIFT * vocabulary.length)[:, None]
    p = np.full((vocabulary.size, len(languages)), 1 / vocabulary.size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((languages, p * lift))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, uses = None, None
            names, q = shared.value  # noqa: B023
            for batch in batches:
                own = own or resident(("lang-fit", path), lambda: Vocabulary(path))
                uses = np.zeros(q.shape) if uses is None else uses
                parts: dict[str, dict[tuple[bool, bytes], int]] = {}
                for lang, word, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    here = parts.setdefault(lang, {})
                    for k, part in enumerate(cut(word.encode())):
                        here[k == 0, part] = here.get((k == 0, part), 0) + times
                for lang, here in parts.items():
                    g = names.index(lang)
                    uses[:, g] += expected_uses(own, here, q[:, g : g + 1])
            if uses is not None:
                piece, g = np.nonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[piece, g])], names=["g", "piece", "n"])

        found = counted.select("lang", "w", "count").mapInArrow(lean(run, tables=True), "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(p.shape)
        n[found["piece"].to_numpy(), found["g"].to_numpy()] = found["n"].to_numpy()
        p = (n + 1e-3) / (n + 1e-3).sum(axis=0)
        shared.unpersist()
    law = n / n.sum(axis=0)
    return languages, (1 - SMOOTHING) * law + SMOOTHING * (0.5 * law.mean(axis=1, keepdims=True) + 0.5 / vocabulary.size)


class Scorer:
    """Log probabilities of words in each language, kept by hash for the words seen lately."""

    def __init__(self, vocabulary: Vocabulary, law: np.ndarray):
        self.vocabulary = vocabulary
        self.p = law * np.exp(LIFT * vocabulary.length)[:, None]
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, law.shape[1]))

    def short(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words of at most LONGEST bytes, lengths falling."""
        out = np.empty((len(lengths), self.p.shape[1]))
        for k in range(0, len(lengths), 4096):
            part = lengths[k : k + 4096]
            alpha = Lattice(self.vocabulary, chars[k : k + 4096], part).forward(self.p)
            out[k : k + 4096] = np.log(alpha[np.arange(len(part)), part]) - LIFT * part[:, None]
        return out

    def long(self, word: np.ndarray) -> np.ndarray:
        """The same sum for a long word, rescaled on the way; what is kept is bounded by the longest piece."""
        tables, p, scale = self.vocabulary.tables, self.p, 0.0
        n, word = len(word), word.tolist()
        ahead: dict[int, np.ndarray] = {}
        for start in range(n):
            here = ahead.pop(start, None)
            if start == 0:
                here = p[self.vocabulary.empty].copy()
            top = here  # of each language by itself: they may drift apart without bound
            here, scale = np.ones_like(top), scale + np.log(top)
            for k in ahead:
                ahead[k] = ahead[k] / top
            parts = [(start + 1, here * p[self.vocabulary.bytes0 + word[start]])]
            for which in (0, 1) if start == 0 else (1,):
                steps, piece_at = tables[which]
                node = 0
                for at in range(start, n):
                    node = steps[node, word[at]]
                    if not node:
                        break
                    if piece_at[node] >= 0:
                        parts.append((at + 1, p[piece_at[node]] / top if which == 0 else here * p[piece_at[node]]))
                    if node >= len(steps):
                        break
            for end, value in parts:
                ahead[end] = ahead[end] + value if end in ahead else value
        return np.log(ahead[n]) + scale - LIFT * n

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the different words of a buffer, and each word's row among them."""
        hashes, one, row = np.unique(Prefix(data).of(starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        have = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        values = np.empty((len(hashes), self.p.shape[1]))
        if have.any():
            values[have] = self.values[at[have]]
        new = np.flatnonzero(~have)
        begin, length = starts[one[new]], (ends - starts)[one[new]]
        for i in np.flatnonzero(length > LONGEST):
            values[new[i]] = self.long(data[begin[i] : begin[i] + length[i]])
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= LONGEST]
        if len(order):
            padded = np.concatenate((data, np.zeros(LONGEST, np.uint8)))
            for k in range(0, len(order), 4096):
                some = order[k : k + 4096]
                chars = padded[begin[some][:, None] + np.arange(int(length[some[0]]))]
                values[new[some]] = self.short(chars, length[some])
        if len(new):
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known, self.values = hashes[:KNOWN_WORDS], values[:KNOWN_WORDS]
            else:
                both = np.concatenate((self.known, hashes[new]))
                order = np.argsort(both, kind="stable")  # two sorted runs
                self.known, self.values = both[order], np.concatenate((self.values, values[new]))[order]
        return values, row


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """lang, w and count: all words of a bounded sample of labelled documents, stored."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = lowest_hash(labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id")), "id", "lang", rows).select("lang", "id").toArrow()
    if not ids.num_rows:
        return spark.createDataFrame([], "lang string, w string, count long")
    # At most `rows` ids a language: a bounded side. Arrow, as rows would start plain Python workers beside the others.
    chosen = F.broadcast(spark.createDataFrame(ids.rename_columns(["of_lang", "of_id"]), f"of_lang string, of_id {dict(docs.dtypes)[id_col]}"))
    text = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(chosen, (F.col("lang") == F.col("of_lang")) & F.col("id").eqNullSafe(F.col("of_id")), "left_semi")
    return materialise(text.select("lang", F.explode(F.split("t", r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''").groupBy("lang", "w").count(), "language_words")


def identify(docs: DataFrame, training: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, others: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Predict the language of every whole text from its text alone.

    training: labelled rows with id_col, text_col and lang_col; at most sample_rows a language are read.
    vocabulary: a sentencepiece model file, present on the driver and every executor; others: columns passed on, keep_text: the text too.
    Returns id_col, others, text_col if kept, lang_pred (a label of training; "und" for a null text, one without a letter, or where
    nothing was learned) and score, the posterior of lang_pred under equal priors (0 for "und"). Ties go to the
    first label in order. Every row gives one row, repeated rows and null ids too. One pass without a shuffle.
    """
    languages, law = fit(vocabulary, training_words(training, id_col, text_col, lang_col, sample_rows))
    model = docs.sparkSession.sparkContext.broadcast((languages, law.astype(np.float32), uuid.uuid4().hex))
    kinds, width = dict(docs.dtypes), 1 + len(others)
    passed = [id_col, *others] + [text_col] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p, fitted = model.value
        scorer = resident(("lang", fitted), lambda: Scorer(Vocabulary(vocabulary), p.astype(float)))
        for batch in batches:
            offsets, data = text_buffer(batch.column(width))
            for lo, hi in slices(offsets, SCORED_BYTES):
                at, raw = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                letter = np.add.reduceat(np.append(LETTERS[raw], False), at[:-1], dtype=np.int64) > 0
                letter &= at[1:] > at[:-1]
                for i in np.flatnonzero(~letter & (at[1:] > at[:-1])):
                    letter[i] = any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode()))
                pred, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if names:
                    starts, ends, first = words(raw, at)
                    values, row = scorer.of(raw, starts, ends)
                    text_of = row_ids(np.diff(first))
                    total = np.stack([np.bincount(text_of, values[row, g], minlength=hi - lo) for g in range(len(names))], axis=1)
                    best = total.argmax(axis=1)
                    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[letter], score[letter] = np.array(names, object)[best[letter]], posterior[letter]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(passed))), pa.array(pred, pa.string()), pa.array(score)], names=[*passed, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in passed) + ", lang_pred string, score double"
    return docs.select(id_col, *others, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(run, tables=True), schema)


LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
