"""Languages whose words end only at white space once a line, and the tail of rare words, are learned."""

import random

import numpy as np
import public_tokenizers

from tracequarry.llm import lang_unigram as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_cut():
    word = ("a日é" * 40).encode()
    parts = L.cut(word)
    assert b"".join(parts) == word and all(0 < len(x) <= L.LONGEST for x in parts) and "".join(x.decode() for x in parts) == "a日é" * 40
    assert L.cut(b"x" * 32) == [b"x" * 32] and L.cut(b"") == []


def test_unspaced_languages(spark):
    rng = random.Random(1)
    han, kana = "的一是不了人我在有他这中大来上个国到说们", "のにはをたがでてとしれさあるいもなこまり"
    line = lambda signs: "".join(rng.choice(signs) for _ in range(60))
    rows = [(k, line(han if k % 2 else kana), "zh" if k % 2 else "ja") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, docs.where("doc_id < 40"), PATH).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_inner_parts_begin_no_word(spark):
    v = L.vocabulary_of(PATH)
    languages, law = L.fit(PATH, spark.createDataFrame([("a", "z" * 200, 1), ("b", "日" * 50, 3)], "lang string, w string, count long"))
    assert languages == ["a", "b"] and np.allclose(law.sum(axis=0), 1)
    # One word that begins, six parts that go on.
    uses = L.expected_uses(v, {(True, b"z"): 1, (False, b"z"): 6}, np.full((v.size, 1), 1.0))
    assert np.isclose((uses * v.length).sum(), 7) and 0 < uses[v.empty] <= 1


def test_rare_words_all_count(spark):
    # More different words than the former bound of 10,000, all once; the end of the alphabet must be learned too.
    docs = spark.createDataFrame([(1, " ".join(f"{a}{k}" for a in ("aa", "zz") for k in range(10_000)), "x"), (2, "dd ee", "y")], "doc_id long, text string, lang string")
    words = {r.w for r in L.training_words(docs, "doc_id", "text", "lang", 10).where("lang = 'x'").collect()}
    assert len(words) == 20_000 and "zz9999" in words
