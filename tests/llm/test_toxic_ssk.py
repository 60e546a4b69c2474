"""Kernel and subsequence lengths against definitions; learning, gaps and edge rows."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.llm import toxic_ssk as T


def slow_kernel(s, t, p, decay):
    def spans(x):
        out = {}
        for at in itertools.combinations(range(len(x)), p):
            if all(x[i].isalnum() for i in at):
                w = "".join(x[i] for i in at)
                out[w] = out.get(w, 0) + decay ** (at[-1] - at[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(a[w] * b[w] for w in a if w in b)


def slow_lcs(s, t):
    row = [0] * (len(t) + 1)
    for x in s:
        new = [0]
        for j, y in enumerate(t, 1):
            new.append(row[j - 1] + 1 if x == y and x.isalnum() else max(row[j], new[-1]))
        row = new
    return row[-1]


WORDS = st.text(alphabet="abcé-. ", min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5), st.text(alphabet="abcé", min_size=1, max_size=7), st.integers(1, 4))
def test_kernel_and_common_length(found, landmark, p):
    s, t = T.codes(found, 12), T.codes([landmark], len(landmark))[:, 0]
    assert np.allclose(T.kernel(s, t, p, 0.6), [slow_kernel(x, landmark, p, 0.6) for x in found], rtol=1e-4, atol=1e-6)
    assert np.allclose(T.kernel(s, s, p, 0.6), [slow_kernel(x, x, p, 0.6) for x in found], rtol=1e-4, atol=1e-6)
    assert T.common_length(s, t).tolist() == [slow_lcs(x, landmark) for x in found]


def test_gram_of_landmarks_is_one_on_itself():
    m = T.Machine(["idiot", "worthless", "trash"])
    k = m.kernels(["idiot", "i-d-i-o-t", "idiooot", "worthless", "unlike"])
    assert np.allclose(k[0, 0], 1) and np.allclose(k[3, 1], 1) and k[1, 0] > 0.9 and k[2, 0] > 0.3 and not k[4].any()


def test_tokens():
    assert T.tokens("You i d i o t, id-iot! x a.b.c.d \n(Trash)...") == ["i d i o t", "id-iot", "x a.b.c.d", "trash"]
    assert T.windows("x" * 24) == ["x" * 24] and "".join(w[:12] for w in T.windows("ab" * 40)).startswith("ab" * 20)
    found = "z" * 17 + "idiot" + "z" * 300
    assert any("idiot" in w for w in T.windows(found))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    extra = [(-1, None), (-2, ""), (-3, "?!"), (-4, "a lovely day " * 3 + "you i d i o t and tra.sh, such scu-m"), (-5, "a lovely day " * 30), (None, "x" * 5000), (-6, "you idiot, trash and scum"), (-6, "you idiot, trash and scum")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    got = T.score(docs.select("doc_id", "text").unionByName(more).withColumn("score", F.lit("clash")), labels.where(~held))
    return got.join(labels, "doc_id", "left").withColumn("held", held).toPandas()


def test_held_out_accuracy(scored):
    x = scored[scored.toxic.notna() & (scored.held == True)]  # noqa: E712
    assert (x.predicted == x.toxic).mean() > 0.97
    assert ((x.predicted == 1) & (x.toxic == 0)).sum() <= 0.01 * len(x)


def test_edges(scored):
    by = {i: g for i, g in scored.groupby(scored.doc_id.fillna(0))}
    assert all(by[i].predicted.iloc[0] == 0 for i in (-1, -2, -3, -5))
    assert by[-4].predicted.iloc[0] == 1 and by[-6].predicted.tolist() == [1, 1] and by[-6].score.nunique() == 1
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in T.score(docs, labels).collect()] == [(0.0, 0)] * 2
    assert T.score(docs, labels.limit(0)).count() == 2 and T.score(docs.limit(0), labels).count() == 0
