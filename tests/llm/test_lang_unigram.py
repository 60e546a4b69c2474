"""The forward sum against recursion over all segmentations; learning; edge rows."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.llm import lang_unigram as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
V = L.vocabulary_of(PATH)
LAW = np.random.default_rng(0).dirichlet(np.ones(V.size), 3).T


@pytest.fixture(scope="module")
def number():
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = sorted({m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))})
    return {p.encode(): i for i, p in enumerate(found)}


def brute(word: bytes, number: dict, law=LAW) -> np.ndarray:
    mark = L.START.encode()
    rest = [np.zeros(law.shape[1]) for _ in word] + [np.ones(law.shape[1])]
    for s in range(len(word) - 1, -1, -1):
        rest[s] = law[V.bytes0 + word[s]] * rest[s + 1] + sum((law[number[word[s:e]]] * rest[e] for e in range(s + 1, len(word) + 1) if word[s:e] in number), np.zeros(law.shape[1]))
    return np.log(law[number[mark]] * rest[0] + sum((law[number[mark + word[:e]]] * rest[e] for e in range(1, len(word) + 1) if mark + word[:e] in number), np.zeros(law.shape[1])))


@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.text(alphabet="athenionéß日z0", min_size=1, max_size=30), min_size=1, max_size=12))
def test_forward_equals_recursion(number, words):
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    starts = ends - [len(w) for w in raw]
    scorer = L.Scorer(V, LAW)
    for _ in range(2):  # the second time from what is kept
        values, row = scorer.of(data, starts, ends)
        for k, w in enumerate(raw):
            assert np.allclose(values[row[k]], brute(w, number), rtol=1e-9)


def test_long_words_do_not_underflow(number):
    word = ("a1é日" * 200).encode()
    assert np.allclose(L.Scorer(V, LAW).long(np.frombuffer(word, np.uint8))[0] / len(word), L.Scorer(V, LAW).long(np.frombuffer(word * 3, np.uint8))[0] / len(word) / 3, rtol=0.02)
    assert np.allclose(L.Scorer(V, LAW).long(np.frombuffer(word[:100], np.uint8)), brute(word[:100], number), rtol=1e-9)


def test_expected_uses_are_the_derivative(number):
    words = [b"station", b"the", b"on"]
    lattice = L.Lattice(V, L.grid(words), np.array([7, 3, 2]))
    p = LAW[:, :1] * np.exp(L.LIFT * V.length)[:, None]
    uses = lattice.expected(p, np.array([2.0, 1.0, 3.0]))
    for piece in (b"on", b"at", L.START.encode(), (L.START + "st").encode(), (L.START + "the").encode()):
        i, h = number[piece], 1e-6
        def total(scale):
            q = p.copy()
            q[i] *= scale
            a = L.Lattice(V, L.grid(words), np.array([7, 3, 2])).forward(q)[:, :, 0]
            return float(np.dot([2.0, 1.0, 3.0], np.log(a[[0, 1, 2], [7, 3, 2]])))
        assert abs((total(1 + h) - total(1 - h)) / (2 * h) - uses[i]) < 1e-4


def test_rows(spark):
    en = "the station and the nation were in that other thing"
    fr = "le jour et la nuit sont dans une autre maison près de là"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "", "fr", "s"), (102, "123 ### 4", "en", "s"), (None, en, None, None), (103, fr, None, "s"), (103, fr, None, "s"), (104, "Ж", None, "s"), (105, "x" * 5000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    got = L.identify(docs, docs.where(~held), PATH).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == ("en" if i % 2 else "fr") and by[i][0].score > 0.9 for i in range(40))
    assert by[None][0].lang_pred == "en" and len(by[103]) == 2 and by[103][0] == by[103][1] and by[103][0].lang_pred == "fr"
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (100, 101, 102))
    assert all(by[i][0].lang_pred in ("en", "fr") and 0 <= by[i][0].score <= 1 for i in (104, 105))
    assert {r.lang_pred for r in L.identify(docs, docs.limit(0), PATH).collect()} == {"und"}
    assert L.identify(docs.limit(0), docs, PATH).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = L.identify(docs, docs.where(~held), PATH, others=("lang",)).where(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98
