"""Mixing sources to target weights by the cube method of balanced sampling.

Every source has a target number of words; the ratio of target to size, at most the cap, is how often each of
its documents should be taken on average. Its whole part is taken outright; the rest is an inclusion
probability. The flight phase moves the probabilities of a few documents at a time along the null-space of the
constraints (sum of probabilities: documents; sum of probability times size: words), so both totals stay while
at each move one probability reaches 0 or 1. Sources are flown in blocks side by side; each leaves at most two
fractions, which are flown again together until a source has one block; the two or fewer fractions left there
are the landing problem, solved by trying all roundings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._text import lean
from tracequarry.operators.corpus import running_before
from tracequarry.plans.shared import materialise

WEIGHTS = (1, 2, 3)
CAP = 3.0
BLOCK = 4096  # documents flown by one walk
#: Up to so many documents the decisions, 63 to a number, are broadcast (64 MB at most), and what is kept stays where it is; beyond, both meet by a shuffle.
MARKED = 1 << 28
_MASK = (1 << 64) - 1


def chance(*parts: int) -> float:
    """A number in [0, 1) fixed by the parts (splitmix64)."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & _MASK
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


def null_vector(sizes: Sequence[float]) -> tuple[float, float, float]:
    """Of three documents: moves that keep the number of documents and of words."""
    a, b, c = sizes
    v = (b - c, c - a, a - b)
    return v if any(v) else (1.0, -1.0, 0.0)


def move(p: list[float], v: Sequence[float], draw: float) -> list[float]:
    """One step of the flight: along v or against it, to the first bound, with chances that keep p on average."""
    ahead = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(p, v) if d)
    back = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(p, v) if d)
    step = ahead if draw * (ahead + back) < back else -back
    out = [x + step * d for x, d in zip(p, v)]
    return [0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in out]


class Flight:
    """Documents come one by one; at most three are open at a time. done() receives each as soon as it is decided."""

    def __init__(self, done):
        self.done, self.open = done, []

    def add(self, row, size: float, p: float, key: int) -> None:
        if p <= 0.0 or p >= 1.0:
            self.done(row, p)
            return
        self.open.append([row, size, p, key])
        while len(self.open) == 3:
            self.step(null_vector([x[1] for x in self.open]))

    def step(self, v: Sequence[float]) -> None:
        keys = [x[3] for x in self.open]
        for x, p in zip(self.open, move([x[2] for x in self.open], v, chance(*keys))):
            x[2] = p
        rest = []
        for x in self.open:
            if 0.0 < x[2] < 1.0:
                rest.append(x)
            else:
                self.done(x[0], x[2])
        self.open = rest

    def leave(self) -> None:
        """Hand out what is open, undecided."""
        for row, _, p, _ in self.open:
            self.done(row, p)
        self.open = []

    def land(self) -> None:
        """Decide what is open: the rounding nearest to the words that are due, then to the documents."""
        if self.open:
            words, number = sum(x[1] * x[2] for x in self.open), sum(x[2] for x in self.open)
            best = min(product((0.0, 1.0), repeat=len(self.open)), key=lambda r: (abs(sum(x[1] * y for x, y in zip(self.open, r)) - words), abs(sum(r) - number), r))
            for x, y in zip(self.open, best):
                self.done(x[0], y)
        self.open = []


FIELDS = "row long, source_no long, block long, key long, size long, p double"


def _fly(units: DataFrame, last: bool) -> DataFrame:
    """row and p of every unit, after one walk over each block. Units of a block arrive in order of key and stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ps, group = [], [], None

        def done(row, p):
            rows.append(row)
            ps.append(p)

        flight = Flight(done)
        for batch in batches:
            for row, source, block, key, size, p in zip(*(c.to_pylist() for c in batch.columns)):
                if (source, block) != group:
                    flight.land() if last else flight.leave()
                    group = (source, block)
                flight.add(row, size, p, key)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ps, pa.float64())], names=["row", "p"])
                rows.clear()
                ps.clear()
        flight.land() if last else flight.leave()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ps, pa.float64())], names=["row", "p"])

    ordered = units.repartition("source_no", "block").sortWithinPartitions("source_no", "block", "key", "size")
    return ordered.select(*(x.split()[0] for x in FIELDS.split(", "))).mapInArrow(lean(run), "row long, p double")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with source_no (its place by code point, null last) and target.

    Weights repeat over the places and share the sum of all sizes; a target stops at cap times its source's size and
    the excess goes to the others by weight, until none is above. Each round brings four numbers to the driver.
    """
    # Numbered in ranges, as there may be a source for every host of a crawl.
    placed = running_before(sources.withColumns({"__all": F.lit(0), "__none": F.col("source").isNull()}), "__all", ["__none", "source"], F.lit(1), "source_no").drop("__all", "__none")
    numbered = materialise(
        placed.withColumn("source_no", F.col("source_no").cast("long")).withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights)).cast("int"))).withColumn("most", cap * F.col("source_size")), "mix_sources"
    )
    total, share, full = None, 0.0, -1
    while True:
        above = F.col("share") > F.col("most")
        # A source once above stays at its cap: what one weight is worth only grows from round to round.
        marked = numbered.withColumn("share", F.col("w") * F.lit(share))
        n, held, left, size = marked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("w"))), F.sum("source_size")).first()
        total = float(size or 0)
        if n == full or not left:
            break
        full, share = n, (total - float(held or 0)) / float(left)
    return numbered.select("source", "source_no", "source_size", F.least(F.col("most"), F.col("w") * F.lit(share)).alias("target"))


def size_of(text):
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: float = CAP, block: int = BLOCK, keep: tuple[str, ...] = (), marked: int = MARKED) -> DataFrame:
    """Decide how often every document is taken so that each source comes near its target.

    Returns keep, id_col, source_col, size (words), source_size, target (its source's, double), copies int and
    taken long (size times copies), one row for each input row. copies is at most the cap rounded up. Draws come
    from hashes of id and size, so reruns agree; equal rows may have different copies. A null text has size 0, a
    null source is a source of its own (last), null and repeated ids are ids like others. A source without a word
    has target 0 and is not taken.
    keep's columns that are named like those below give way to them. Of a very long text only the size matters.
    Only ids, sizes and sources are shuffled, above `marked` documents also what keep names; a large source is dealt over many blocks.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in dict.fromkeys((*keep, id_col)) if c not in own]
    # What is kept goes along as one struct, whose fields' names meet no others.
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__kept"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size_of(F.col(text_col).cast("string")).alias("__size"))
    sized = materialise(sized.withColumn("__key", F.xxhash64("__id", "__size")).withColumn("__row", F.monotonically_increasing_id()), "mix_sized")
    sources = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    counted = targets(sources.select("source", "source_size"), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    counted = counted.withColumnRenamed("source", "__of")
    units = sized.join(counted, F.col("__source").eqNullSafe(F.col("__of"))).withColumns({"whole": whole.cast("int"), "part": F.greatest(ratio - whole, F.lit(0.0))})
    flying = units.where(F.col("part") > 1e-9).select(F.col("__row").alias("row"), "source_no", F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("part").alias("p"))
    decided = []
    while True:
        # Stored, so its size is known: while it is small the join needs no shuffle by source, which a hot one would fill.
        per = materialise(flying.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")), "mix_counts")
        most = per.agg(F.max("n")).first()[0] or 0
        last = most <= block
        # Blocks of equal number for every source, by hash: none larger than a few times `block` unless keys repeat, and those stream.
        number = F.ceil(F.col("n") / block)
        dealt = flying.join(per, "source_no").withColumn("block", F.lit(0).cast("long") if last else F.pmod(F.xxhash64("key"), number)).drop("n")
        flown = materialise(_fly(dealt, last), "mix_flown")
        decided.append(flown.where((F.col("p") == 0) | (F.col("p") == 1)))
        if last:
            break
        flying = flown.where((F.col("p") > 0) & (F.col("p") < 1)).join(flying.drop("p"), "row").select("row", "source_no", "key", "size", "p")
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.unionByName(d)
    taken = chosen.where("p = 1").select("row")
    if sized.count() <= marked:
        word = F.expr("row div 63")
        words = taken.groupBy(word.alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row % 63 AS int))")).alias("__bits"))
        done = units.withColumn("__place", F.expr("__row div 63")).join(F.broadcast(words), F.col("__place") == F.col("__word"), "left").withColumn("extra", F.expr("cast(shiftright(__bits, cast(__row % 63 AS int)) & 1 AS int)"))
    else:
        done = units.join(taken.select(F.col("row").alias("__chosen"), F.lit(1).alias("extra")), F.col("__row") == F.col("__chosen"), "left")
    copies = F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))
    source = [] if source_col in names else [F.col("__source").alias(source_col)]
    return done.select(*(F.col("__kept").getField(c).alias(c) for c in names), *source, F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("__size") * copies).alias("taken"))
