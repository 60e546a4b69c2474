"""Near-duplicate texts: Jaccard similarity of word n-grams, with Bayesian pruning of candidate pairs.

1. Each text becomes the set of hashes (64 bits) of its runs of five words [^\\x20\\x09-\\x0D]+ (a shorter text: of
   all its words) and MinHash values of that set. Equal sets are one node; equal texts come along.
2. Values are grouped in bands; nodes that share a band are candidates. A pair of similarity s is missed with
   probability (1 - s^rows)^bands: at 128 values in 32 bands of 4 below 5e-8 for s = 0.8.
3. Candidates are compared value by value, some at a time. After n values of which m agree, the posterior of the
   similarity is a Beta law (uniform prior); the pair is dropped once the probability that it reaches the
   threshold is below the tolerance. Survivors make rough components.
4. In each rough component all pairs are verified exactly, by set intersection of the n-gram hashes. Links are
   counted and what they connect becomes a class.

Large buckets and components are cut into blocks; every pair of blocks is one unit of work, so no task gets a
whole group, and a unit's rows leave as counts and as a forest of links, not as pairs.

Texts stay where they are. Signatures and digests move; of the texts only one of each n-gram set that has a candidate
does, as n-grams. A bitmap of fixed size tells the second scan which rows those are (a row that it lets by in error
goes in the exact join behind it). Texts with very many copies are joined by broadcast, as there are few of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._text import Prefix, groups, lean, shingles, slices, text_buffer, words
from tracequarry.plans.components import connected_components
from tracequarry.plans.shared import materialise
from tracequarry.plans.skew import join_split

WORDS, THRESHOLD = 5, 0.8
VALUES, BANDS = 128, 32
ROWS = VALUES // BANDS
STEP = 16  # values compared between two looks at the posterior
TOLERANCE = 1e-6
BLOCK = 512  # nodes of a block
MARKS = 1 << 26  # bits of the bitmap that tells which rows' texts are wanted: 8 MB
_A = np.random.default_rng(20240229).integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(20240301).integers(0, 1 << 32, VALUES, dtype=np.uint32)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """VALUES minima of a set of 64-bit hashes."""
    out, low = np.full(VALUES, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 2048):
        part = low[k : k + 2048]
        # Odd multiples, then a fold that breaks their order, so minima under two functions are unrelated.
        x = part[None, :] * _A[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += _B[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def posterior(agree: int, of: int, threshold: float) -> float:
    """Probability that the similarity is at least the threshold, after `agree` of `of` values agree (uniform prior).

    The tail of Beta(agree + 1, of - agree + 1), as a binomial sum.
    """
    n = of + 1
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(threshold) + (n - k) * math.log1p(-threshold)) for k in range(agree + 1)))


@lru_cache(8)
def least_agreeing(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> tuple[int, ...]:
    """For each look, the fewest agreeing values with which a pair goes on."""
    return tuple(next(m for m in range(n + 1) if m == n or posterior(m, n, threshold) >= tolerance) for n in range(step, values + 1, step))


class Forest:
    """Union-find over 0..n-1; the smallest is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        """The roots of all, with every path made short."""
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def survivors(left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of signatures (n, VALUES) survive the pruning."""
    alive, agree = np.arange(len(left)), np.zeros(len(left), np.int32)
    for look, need in enumerate(least):
        at = slice(look * STEP, (look + 1) * STEP)
        agree += (left[alive, at] == right[alive, at]).sum(axis=1, dtype=np.int32)
        on = agree >= need
        alive, agree = alive[on], agree[on]
    return alive


def rough_links(ids: np.ndarray, signatures: np.ndarray, second: np.ndarray, least: tuple[int, ...]) -> list[tuple[int, int]]:
    """A forest of the surviving pairs within a block, or between its first and second part.

    A node is compared with the nodes that it is not yet connected to.
    """
    n, links = len(ids), []
    parts = Forest(n)
    across = second.any() and not second.all()
    label = np.arange(n)
    for i in range(n):
        others = np.flatnonzero((label != label[i]) & (second != second[i])) if across else i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if across:
            others = others[others > i]
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            for j in some[survivors(np.broadcast_to(signatures[i], (len(some), VALUES)), signatures[some], least)]:
                if parts.join(i, int(j)):
                    links.append((i, int(j)))
                    a, b = label[i], label[j]
                    label[label == max(a, b)] = min(a, b)
    return links


def exact_links(sets: list[np.ndarray], second: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weight of the sets linked to each, within a block or between its two parts, and a forest of the links."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    across = second.any() and not second.all()
    parts, links = Forest(n), []
    # Intersections by the product of the incidence matrix with itself, over n-grams held by two sets or more.
    grams, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    values, column, seen = np.unique(grams, return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    on = shared[column]
    owner, column = owner[on], number[column[on]]
    meet = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for k in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, (k, k + 4096))
        incidence = np.zeros((n, 4096), np.float32)
        incidence[owner[lo:hi], column[lo:hi] - k] = 1
        meet += incidence @ incidence.T
    joint = sizes[:, None] + sizes[None, :] - meet
    # Counts below 2**24 are exact; the comparison is of whole numbers where the threshold allows it.
    linked = meet >= threshold * joint - 1e-6
    np.fill_diagonal(linked, False)
    if across:
        linked &= second[:, None] != second[None, :]
    counts = linked @ weight
    for i in range(n):
        # From the least node on, only those not yet connected: a forest without walking over all pairs.
        for j in i + 1 + np.flatnonzero(linked[i, i + 1 :] & (parts.roots()[i + 1 :] != parts.root(i))):
            if parts.join(i, int(j)):
                links.append((i, int(j)))
    return counts, links


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of n-gram hashes of each text, sorted."""
    offsets, data = text_buffer(texts)
    for lo, hi in slices(offsets):
        at, raw = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        starts, ends, first = words(raw, at)
        hashes = Prefix(raw).of(starts, ends)
        grams, begin = shingles(hashes, first, WORDS)
        cut = np.searchsorted(begin, first)
        for k in range(hi - lo):
            n = int(first[k + 1] - first[k])
            if 0 < n < WORDS:
                yield shingles(hashes[first[k] : first[k + 1]], np.array([0, n]), n)[0]
            else:
                yield np.unique(grams[cut[k] : cut[k + 1]])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, signs = [], []
        for own, same in zip(_sets(batch.column(2)), batch.column(1).to_pylist()):
            # A text without a word has no n-grams: only equal texts are its copies.
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else same)
            signs.append(minhash(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["id", "same", "key", "signature"])


def _with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            some = batch.slice(lo, 500)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([own.tobytes() for own in _sets(some.column(2))], pa.binary())], names=["same", "id", "grams"])


def _mark(same: str, id_col: str) -> Column:
    return F.pmod(F.xxhash64(same, id_col), F.lit(MARKS))


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (same, id, ...) without most of those that are not in wanted (same, id), and without moving any: a broadcast of at most MARKS bits."""
    word = F.floor(F.col("m") / 63)
    bitmap = wanted.select(_mark("same", "id").alias("m")).groupBy(word.alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 63 AS int))")).alias("__bits"))
    marked = rows.withColumn("m", _mark("same", "id")).withColumn("__word", word)
    # At most MARKS / 63 rows of two numbers.
    hit = F.expr("shiftright(__bits, cast(m % 63 AS int)) & 1") == 1
    return marked.join(F.broadcast(bitmap), "__word").where(hit).drop("m", "__word", "__bits")


def _pairs(found: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> pa.RecordBatch:
    u = [ids[i] for ids, links in found for i, _ in links]
    v = [ids[j] for ids, links in found for _, j in links]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _in_blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """rows (group, node, n: the group's rows, ...) dealt to units: one for every pair of blocks of a group.

    second tells the rows of a unit's second block. A group of n rows has ceil(n / size) blocks, and each row goes to
    as many units.
    """
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cut = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).withColumn("second", (F.col("low") != F.col("high")) & (F.col("own") == F.col("high")))
    return cut.drop("own", "other").repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "node")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Class and number of links of every document.

    Returns one row for each input row: id_col, class_id (the least id_col of its class), n_links long (different
    texts, besides its own, whose similarity to it is at least the threshold), n_copies long (rows with its text,
    itself included) and __same binary (a digest of the text). A class is what links and equal texts connect.
    Similarity is that of the sets of five-word runs; of texts with fewer words, the run of all their words. Texts
    without a word link with nothing; equal ones share a class. A null text is a class of its own, with n_copies 1
    and its own id; null ids are ignored when the least is taken.
    A very long text is handled alone, in one task, in memory of some ten times its length. Extra columns are not read.
    Candidates are missed with a probability below (1 - threshold**4)**32 each, pruned ones with the tolerance.
    """
    kind = dict(docs.dtypes)[id_col]
    least = least_agreeing(threshold, tolerance)
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("same"), text.alias("t"))
    signed = materialise(picked.where("t IS NOT NULL").mapInArrow(lean(_signed), f"id {kind}, same binary, key binary, signature binary"), "signed")
    # Copies and the least id of each text; a signature moves once, with the first of its n-gram set in a task.
    texts = materialise(signed.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("id")), "texts")
    about = texts.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("id"), F.min(F.struct("same", "id")).alias("text"), F.sum("n_copies").alias("n_rows"))
    signs = signed.groupBy("key").agg(F.min("signature").alias("signature"))
    nodes = materialise(about.join(signs, "key").select("key", "weight", "id", "n_rows", F.col("text.same").alias("same"), F.col("text.id").alias("text_id"), "signature").withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Bands: one row for each node and band; a bucket is known by what it holds, so equal buckets count once.
    width = ROWS * 4
    bands = nodes.where("signature IS NOT NULL").select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * width + 1, F.lit(width))))).alias("bucket"))
    held = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.min("node").alias("b"), F.max("node").alias("c")).where("n > 1")
    buckets = held.groupBy("n", "a", "b", "c").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = materialise(bands.join(buckets, "bucket"), "members")
    rough = _in_blocks(members.join(nodes.select("node", "signature"), "node").select("bucket", "node", "n", "signature"), "bucket", 2 * block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for unit in groups(batches, 3):
            ids = unit.column("node").to_numpy()
            signatures = np.frombuffer(b"".join(unit.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            found.append((ids, rough_links(ids, signatures, unit.column("second").to_numpy(), least)))
            if len(found) >= 1000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    rough = connected_components(rough.select("bucket", "low", "high", "node", "second", "signature").mapInArrow(lean(compare), "u long, v long"))

    # Exact: one text of each of the nodes in question. Repeated rows have equal n-grams, and one stays.
    sizes = rough.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    asked = materialise(rough.join(sizes, "root").join(nodes.select("node", "same", "text_id", "weight"), "node"), "asked")
    wanted = asked.select("same", F.col("text_id").alias("id"))
    own = _only(picked.where("t IS NOT NULL"), wanted).select("same", "id", "t").mapInArrow(lean(_with_grams), f"same binary, id {kind}, grams binary")
    grams = own.groupBy("same", "id").agg(F.min("grams").alias("grams"))
    units = _in_blocks(asked.join(grams.withColumnRenamed("id", "grams_id"), "same").where(F.col("grams_id").eqNullSafe(F.col("text_id"))), "root", block).select("root", "low", "high", "node", "second", "weight", "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, 3):
            ids = unit.column("node").to_numpy()
            sets = [np.frombuffer(g, np.uint64) for g in unit.column("grams").to_pylist()]
            counts, links = exact_links(sets, unit.column("second").to_numpy(), unit.column("weight").to_numpy(), threshold)
            # Counts as (node, null, count), links as (node, node, null).
            some = np.flatnonzero(counts)
            u = np.concatenate((ids[some], np.array([ids[i] for i, _ in links], np.int64)))
            v = pa.array([None] * len(some) + [int(ids[j]) for _, j in links], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array([int(counts[i]) for i in some] + [None] * len(links), pa.int64())], names=["u", "v", "n_links"])

    exact = materialise(units.mapInArrow(lean(verify), "u long, v long, n_links long"), "exact")
    classes = connected_components(exact.where("v IS NOT NULL").select("u", "v"))
    counted = exact.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n_links").alias("others"))
    known = nodes.select("node", "key", "id", "weight").join(classes, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("id").alias("class_id"))
    about = known.join(named, "root").select("key", "class_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    each = materialise(texts.select("key", "same", "n_copies").join(about, "key").select("same", "class_id", "n_links", "n_copies"), "each")
    rows = each.agg(F.sum("n_copies")).first()[0] or 0
    full = join_split(signed.select("id", "same"), each.withColumn("__n", F.col("n_copies")), "same", "__n", rows).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", F.col("same").alias("__same"))
    alone = picked.where("t IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("binary").alias("__same"))
    return full.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the least id (null last), of equal ids the text of least digest, of equal rows one."""
    names = docs.columns
    found = jaccard_classes(docs, id_col, text_col, threshold)
    # Rows of null text are classes of their own and all stay.
    first = found.where(F.col("__same").isNotNull()).groupBy("class_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col).alias("id"), F.col("__same").alias("same"))).alias("m")).select(F.col("m.same").alias("__of"), F.col("m.id").alias("__id"))
    text = F.col(text_col).cast("string")
    # docs as one struct, whose fields' names meet no others; keys without null, so that one shuffle serves the join and the drop.
    key = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n"))
    first = first.select("__of", key(F.col("__id")).alias("__id"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.unhex(F.md5(text)).alias("__same"), key(F.col(id_col)).alias("__key"))
    kept = rows.where("__same IS NOT NULL").join(first, (F.col("__same") == F.col("__of")) & (F.col("__key") == F.col("__id")), "left_semi")
    return kept.dropDuplicates(["__same", "__key"]).unionByName(rows.where("__same IS NULL")).select("__row.*")
