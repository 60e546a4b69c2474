"""Base counts and scores against word-at-a-time versions."""

import math
import random
import re
from collections import Counter

import pyarrow as pa

from tracequarry.llm import quality_llr as Q
from tracequarry.llm._text import Prefix, shingles, text_buffer, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    marked = {k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(found) < 10 or 100 * len(marked) > 20 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def texts() -> list[str | None]:
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "né", "x#", "日本", "|", "<b>", "  ", "\t", "\n", "\n", "\r\n", "\x0b", " ", "🙂"]
    made = ["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.choice([0, 3, 12, 40, 200]))) for _ in range(150)]
    return [None, "", "\n\n", " x ", "a b c d e a b c d e f", "w " * 30_000, "line\nline\n line\nline ", *made]


def test_base_counts(spark):
    found = texts()
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(found)], "doc_id long, text string, n_words string, kept int").repartition(3)
    trusted = spark.createDataFrame([(9,), (10,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in Q.quality_rules(docs, trusted).collect()}
    assert len(got) == len(found)
    for i, t in enumerate(found):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert not (r.base_failed and r.kept)
    assert Q.quality_rules(docs.limit(0), trusted).count() == 0
    assert Q.quality_rules(docs, trusted.limit(0)).where("llr <> 0").count() == 0


def bucket_of(gram: list[str]) -> int:
    offsets, data = text_buffer(pa.array([" ".join(gram)]))
    starts, ends, first = words(data, offsets)
    h = Prefix(data).of(starts, ends)
    if len(gram) == 2:
        return int(shingles(h, first, 2)[0][0] & (Q.BUCKETS - 1)) + Q.BUCKETS
    return int(h[0] & (Q.BUCKETS - 1))


def test_scores(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(9000)) for _ in range(20)]
    bad = [" ".join(rng.choice("zz$ yy# alpha".split()) for _ in range(3000)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    raw, target = Counter(), Counter()
    grams = {}
    for i, t in enumerate(good + bad):
        w = t.split()
        grams[i] = [bucket_of([x]) for x in w] + [bucket_of(w[k : k + 2]) for k in range(len(w) - 1)]
        raw.update(grams[i])
        target.update(grams[i] if i < 10 else [])

    def law(c: Counter, b: int) -> float:
        return (c[b] + 1) / (sum(n for x, n in c.items() if (x < Q.BUCKETS) == (b < Q.BUCKETS)) + Q.BUCKETS)

    got = {r.doc_id: r for r in Q.quality_rules(docs, trusted, threshold=0.0).collect()}
    for i in grams:
        true = sum(math.log(law(target, b) / law(raw, b)) for b in grams[i]) / len(grams[i])
        assert abs(got[i].llr - true) < 1e-4
        assert got[i].kept == (not got[i].base_failed and got[i].llr >= 0)
    again = {r.doc_id: r.llr for r in Q.quality_rules(docs.repartition(7), trusted, threshold=0.0).collect()}
    assert all(again[i] == got[i].llr for i in grams)


def test_trusted_texts_by_bits_and_by_shuffle(spark):
    ids = [-(1 << 63), -65, -64, -1, 0, 62, 63, 64, 127, (1 << 63) - 1, 64, None]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    wanted = {-(1 << 63), -64, -1, 63, 64, (1 << 63) - 1}
    trusted = spark.createDataFrame([(i,) for i in [*wanted, 64, 999, None]], "doc_id long")
    for marked in (1000, 0):
        got = sorted(r[0] for r in Q._trusted_texts(docs, trusted, "doc_id", "text", marked).collect())
        assert got == sorted(f"t{k}" for k, i in enumerate(ids) if i in wanted)
