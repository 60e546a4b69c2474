"""Toxicity: a support vector machine on the gap-weighted subsequence kernel, with Nystroem landmarks.

Text is cut in chunks: words (lower case, other signs at their ends removed), and runs of three or more single
characters, which count as one chunk with gaps ("i d i o t"). The kernel of two chunks sums, over all common
subsequences of P letters, LAMBDA to the power of the stretches that they cover in both; characters inserted
into a word or between its letters only widen the stretch, so "id-i.ot" stays near "idiot". Normalised kernels
with a few landmark chunks give Nystroem features, on which a linear machine is trained: its positive cases are
the witnesses of labelled toxic sentences (chunks that toxic texts have far more often than clean ones), its
negative ones chunks of clean sentences. A text's decision is that of its worst passage, the highest density of
positive chunk decisions (an innocent word may come near an insult once) over overlapping windows of PASSAGE chunks,
so a text's length takes nothing away; a sigmoid fitted on the training texts makes a score of it.
A landmark counts for a chunk only if the two share, in order, at least P letters and NEAR of the landmark's, which
a bit-parallel test of the longest common subsequence finds before the kernel is computed; inserted and gapped
characters take no letter away.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._sample import lowest_hash
from tracequarry.llm._text import resident
from tracequarry.plans.shared import materialise

P, LAMBDA, NEAR = 4, 0.6, 0.65
LANDMARKS = 24  # stems of telling chunks
HARD = 8  # and of the clean chunks that come nearest
#: The fit reads at most so many labelled documents of each label, those of lowest hash of their id, ...
SAMPLE_ROWS = 2000
#: ... and of their chunks the most telling ones of the toxic, and of the clean those in most documents and those of lowest hash.
TELLING, COMMON, OTHER = 400, 6000, 3000
#: A telling chunk is in so many different toxic sample documents at least, and so many times as often as in clean ones.
LEAST_DOCUMENTS, LEAST_RATE = 4, 8.0
#: A stem's worth (documents times log rate) as a share of the best one's, at least.
LEAST_WORTH = 0.1
LONGEST = 24  # characters of a chunk that are compared at once; a longer chunk is compared window by window
PASSAGE = 200  # chunks of a passage; a passage begins every quarter of that
STEM = 10  # letters of the longest stem that is counted
KNOWN_CHUNKS = 500_000

_CHUNK = re.compile(r"(?<!\S)\w(?:[\s.\-*_]+\w(?!\w)){2,}|\S+")
_SIGNS = string.punctuation + "¡¿«»‹›„“”‚‘’…–—·"


def tokens(text: str) -> list[str]:
    """The chunks of a text, in order; those of fewer than P characters are left out."""
    return [c for raw in _CHUNK.findall(text.lower()) if len(c := raw.strip(_SIGNS)) >= P]


def windows(chunk: str) -> list[str]:
    """A chunk of at most LONGEST characters is its own window; a longer one has windows that overlap by half."""
    return [chunk] if len(chunk) <= LONGEST else [chunk[k : k + LONGEST] for k in range(0, len(chunk) - LONGEST // 2, LONGEST // 2)]


def pieces(chunk: str) -> list[str]:
    """A long chunk in pieces of two windows, so that a text without spaces has passages too; a shorter chunk is one piece."""
    return [chunk] if len(chunk) <= LONGEST else [chunk[k : k + LONGEST + LONGEST // 2] for k in range(0, len(chunk) - LONGEST // 2, LONGEST)]


def worst(hits: np.ndarray, lengths: np.ndarray) -> float:
    """Log density, a thousand characters, of the passage where it is highest; of nothing for a text without a chunk."""
    step = PASSAGE // 4
    begin = np.arange(0, max(1, len(hits) - PASSAGE + step), step)
    end = np.minimum(begin + PASSAGE, len(hits))
    h, n = (np.concatenate(([0.0], np.cumsum(x))) for x in (hits, lengths))
    return float((np.log(np.maximum(h[end] - h[begin], 0) + 0.05) - np.log((n[end] - n[begin]) / 1000 + 0.2)).max())


def codes(found: list[str], width: int) -> np.ndarray:
    """Strings as columns: code points of letters and digits, 0 for other signs and the rest, which match nothing."""
    flat = np.frombuffer("".join([c.ljust(width, "\0") for c in found]).encode("utf-32-le"), np.uint32).astype(np.int32).reshape(len(found), width)
    gaps = [c for c in np.unique(flat).tolist() if not chr(c).isalnum()]
    return np.ascontiguousarray(np.where(np.isin(flat, gaps), 0, flat).T)


def kernel(s: np.ndarray, t: np.ndarray, p: int = P, decay: float = LAMBDA) -> np.ndarray:
    """Gap-weighted subsequence kernel of each column of s (length, n) with t: one string (m,) or a column each (m, n).

    The dynamic programme of Lodhi and others; all strings at once, one letter of s after another.
    """
    (longest, n), m = s.shape, len(t)
    total = np.zeros(n, np.float32)
    # ahead[q][j]: K' of level q between the letters of s so far and the first j letters of t.
    ahead = [np.ones((m + 1, n), np.float32)] + [np.zeros((m + 1, n), np.float32) for _ in range(p - 1)]
    square, decay = np.float32(decay * decay), np.float32(decay)
    for i in range(longest):
        match = ((s[i] == t) if t.ndim == 2 else (s[i][None, :] == t[:, None])) & (s[i] != 0)[None, :]
        hit = match.any(axis=1)
        match = match * square
        for j in np.flatnonzero(hit):
            total += match[j] * ahead[p - 1][j]
        for q in range(p - 1, 0, -1):
            # Level q takes level q - 1 of the letters before; so the highest level goes first.
            k2 = np.zeros(n, np.float32)
            for j in range(m):
                k2 *= decay
                if hit[j]:
                    k2 += match[j] * ahead[q - 1][j]
                ahead[q][j + 1] *= decay
                ahead[q][j + 1] += k2
    return total


def common_length(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each column of s with t, by bits (t has at most LONGEST letters)."""
    alphabet = np.unique(t)
    masks = np.array([0] + [sum(1 << j for j, c in enumerate(t) if c == a) for a in alphabet], np.int32)
    place = np.searchsorted(alphabet, s)
    place = np.where(alphabet[np.minimum(place, len(alphabet) - 1)] == s, place + 1, 0)
    full = np.int32((1 << len(t)) - 1)
    v = np.full(s.shape[1], full, np.int32)
    for i in range(len(s)):
        u = v & masks[place[i]]
        v = ((v + u) | (v - u)) & full
    return len(t) - np.bitwise_count(v).astype(np.int64)


class Machine:
    """Landmarks, the map to features and the trained machine."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = [np.array([ord(x) for x in c if x.isalnum()], np.int32)[:LONGEST] for c in landmarks]
        self.own = np.array([kernel(t[:, None], t)[0] for t in self.landmarks])
        gram = np.array([self.against(t[:, None])[0] for t in self.landmarks])
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-4
        self.project = vectors[:, keep] / np.sqrt(values[keep])
        self.w, self.b = np.zeros(self.project.shape[1]), -1.0
        self.slope, self.shift = 1.0, 0.0
        self.name = uuid.uuid4().hex

    def against(self, s: np.ndarray) -> np.ndarray:
        """Normalised kernels of columns of s: (n, landmarks)."""
        out, own = np.zeros((s.shape[1], len(self.landmarks))), np.full(s.shape[1], np.nan)
        for k, t in enumerate(self.landmarks):
            near = np.flatnonzero(common_length(s, t) >= max(P, NEAR * len(t)))
            if len(near):
                some = s[:, near]
                todo = np.isnan(own[near])
                if todo.any():
                    own[near[todo]] = kernel(some[:, todo], some[:, todo])
                out[near, k] = kernel(some, t) / np.sqrt(own[near] * self.own[k])
        return out

    def kernels(self, found: list[str]) -> np.ndarray:
        """Normalised kernels of strings of at most LONGEST characters: (strings, landmarks). Those of like length go together."""
        out, lengths = np.zeros((len(found), len(self.landmarks))), np.array([len(c) for c in found])
        for low, high in ((0, 8), (8, 12), (12, LONGEST)):
            at = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(at), 16384):
                out[at[k : k + 16384]] = self.against(codes([found[i] for i in at[k : k + 16384]], high))
        return out

    def features(self, found: list[str]) -> np.ndarray:
        return self.kernels(found) @ self.project

    def decide(self, found: list[str]) -> np.ndarray:
        """Decision of each chunk: the highest of its windows."""
        parts = [(i, w) for i, c in enumerate(found) for w in windows(c)]
        out = np.full(len(found), -np.inf)
        if parts:
            np.maximum.at(out, np.array([i for i, _ in parts]), self.features([w for _, w in parts]) @ self.w + self.b)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 400) -> None:
        """Squared hinge loss with an L2 penalty, by Newton steps on the active rows; y is 1 or -1."""
        x1 = np.hstack((x, np.ones((len(x), 1))))
        w = np.zeros(x1.shape[1])
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-3
        for _ in range(rounds):
            active = y * (x1 @ w) < 1
            a, s = x1[active], weight[active]
            new = np.linalg.solve(ridge + 2 * c * (a * s[:, None]).T @ a, 2 * c * (a * (s * y[active])[:, None]).sum(axis=0))
            if np.abs(new - w).max() < 1e-9:
                break
            w = 0.5 * w + 0.5 * new
        self.w, self.b = w[:-1], float(w[-1])


def sigmoid_fit(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid of decisions, by Newton steps on smoothed labels; the cut between the labels has score 0.5."""
    order = np.argsort(f)
    good = np.concatenate(([0], np.cumsum(y[order] == 0))) + np.concatenate((np.cumsum((y[order] == 1)[::-1])[::-1], [0]))
    cuts = np.flatnonzero(good == good.max())
    k = int(cuts[len(cuts) // 2])
    edge = np.concatenate(([f.min() - 1], f[order], [f.max() + 1]))
    shift = float((edge[k] + edge[k + 1]) / 2)
    slope, target = 1.0, np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(slope * (f - shift), -30, 30)))
        gradient, curve = ((s - target) * (f - shift)).sum(), (s * (1 - s) * (f - shift) ** 2).sum() + 1e-6
        slope = float(np.clip(slope - gradient / curve, 0.1, 50))
    return slope, shift


def scorer_of(machine: Machine) -> Scorer:
    """One scorer per worker and machine."""
    return resident(("toxic", machine.name), lambda: Scorer(machine))


class Scorer:
    """Scores of texts; decisions of the chunks seen lately are kept."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        """Log density of positive chunk decisions in each text's worst passage."""
        per = [[p for c in tokens(t) for p in pieces(c)] if t else [] for t in texts]
        new = list({c for own in per for c in own if c not in self.known})
        if len(self.known) + len(new) > KNOWN_CHUNKS:
            self.known = {}
            new = list({c for own in per for c in own})
        self.known.update(zip(new, np.clip(self.machine.decide(new), 0, 1).tolist()))
        return np.array([worst(np.array([self.known[c] for c in own]), np.array([len(c) + 1 for c in own])) for own in per], float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.machine
        return 1 / (1 + np.exp(-np.clip(m.slope * (self.decisions(texts) - m.shift), -30, 30)))


def spread(found: list[str], most: int) -> list[str]:
    """Of strings in order of worth, those that neither begin nor go on another already taken: every stem has one landmark."""
    taken: list[str] = []
    for c in found:
        if len(taken) < most and not any(c.startswith(t) or t.startswith(c) for t in taken):
            taken.append(c)
    return taken


def holds(chunk: str, stem: str) -> bool:
    """Whether the stem's letters are in the chunk, in order."""
    rest = iter(chunk)
    return all(x in rest for x in stem)


def fit(sample: DataFrame) -> Machine | None:
    """Train on a stored sample (text, label). What reaches the driver is bounded by the parameters.

    Landmarks are stems, the beginnings of chunks: inflected forms of an insult are rare one by one, their stem is not.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w for c in tokens(t or "") for w in windows(c)}
                # The least hash of a text's chunks stands for it: near copies mostly have the same, and count once.
                least = min((zlib.crc32(c.encode()) for c in own), default=0)
                words, stems = sorted(own), sorted({c[:k] for c in own for k in range(P, min(len(c), STEM) + 1) if c[:k].isalnum()})
                n = len(words) + len(stems)
                yield pa.RecordBatch.from_arrays([pa.array(words + stems, pa.string()), pa.array([False] * len(words) + [True] * len(stems), pa.bool_()), pa.array([y] * n, pa.int32()), pa.array([least] * n, pa.int64())], names=["c", "stem", "y", "m"])

    cases = sample.select("text", "label").mapInArrow(cut, "c string, stem boolean, y int, m long").distinct()
    counted = materialise(cases.groupBy("c", "stem").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")), "chunks")
    n_bad, n_good = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    if not n_bad or not n_good:
        return None
    rate = (F.col("bad") / float(n_bad)) / ((F.col("good") + 1) / float(n_good))
    telling = counted.where((F.col("bad") >= LEAST_DOCUMENTS) & (rate > LEAST_RATE)).withColumn("worth", F.col("bad") * F.log(rate))
    stems = telling.where("stem").orderBy(F.desc("worth"), F.length("c").desc(), "c").limit(TELLING).toPandas()
    stems = stems["c"][stems["worth"] >= LEAST_WORTH * stems["worth"].max()].tolist() if len(stems) else []
    words = telling.where("NOT stem").orderBy(F.desc("worth"), "c").limit(TELLING).toPandas()
    clean = counted.where(~F.col("stem") & (F.col("good") > 0) & (rate < LEAST_RATE / 2))
    common = clean.orderBy(F.desc("good"), "c").limit(COMMON).toPandas()["c"].tolist()
    other = clean.orderBy(F.xxhash64("c"), "c").limit(OTHER).toPandas()["c"].tolist()
    kinds = spread(stems, LANDMARKS)
    # Telling chunks without a stem come from single texts and their copies.
    words = words[[any(holds(c, k) for k in kinds) for c in words["c"]]] if len(words) else words
    if not len(words):
        return None
    worth, telling = words["bad"].to_numpy(float), words["c"].tolist()
    negative = sorted({*common, *other} - set(telling))
    y = np.array([1.0] * len(telling) + [-1.0] * len(negative))
    heavy = np.ones(len(negative))
    for _ in range(2):
        machine = Machine(kinds)
        weight = np.concatenate((worth / worth.sum(), heavy / heavy.sum())) * len(y) / 2
        machine.train(machine.features(telling + negative), y, weight)
        # Once more with the clean chunks that come nearest to toxic ones as landmarks, and with more weight on them.
        decided = machine.decide(negative)
        near = np.argsort(-decided, kind="stable")[:200]
        near = near[decided[near] > -0.5]
        heavy[near] = 50.0
        kinds = kinds + [negative[i] for i in near[:HARD]]
    return machine


def calibrated(machine: Machine, sample: DataFrame) -> Machine:
    """The sigmoid, from the sample's decisions (one number a row)."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer.decisions(batch.column(0).to_pylist())), batch.column(1)], names=["f", "y"])

    found = sample.select("text", "label").mapInArrow(decide, "f double, y int").toPandas()
    machine.slope, machine.shift = sigmoid_fit(found["f"].to_numpy(), found["y"].to_numpy())
    return machine


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity of every whole text.

    labels: id_col and label_col (0 or 1) of the rows that may be learned from; at most sample_rows of each label
    are, those of lowest hash of their id. Returns id_col, score double (0 to 1; that of a text without a chunk for
    a null or empty one) and predicted int (1 from 0.5 on), one row for each input row, null and repeated ids too.
    Where nothing can be learned, scores are 0. The sample is stored once; the texts are scored in one pass
    without a shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    ids = lowest_hash(usable, "id", "label", sample_rows).select("id", "label").toPandas()
    machine = None
    if len(ids):
        # At most 2 * sample_rows ids: a bounded side.
        chosen = F.broadcast(spark.createDataFrame(ids, f"id {kind}, label int"))
        sample = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("text", "label"), "labelled")
        machine = fit(sample)
        machine = machine and calibrated(machine, sample)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value) if shared.value else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                found = scorer.scores(some.column(1).to_pylist()) if scorer else np.zeros(some.num_rows)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
