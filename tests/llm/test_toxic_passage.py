"""A toxic passage counts whatever stands around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import toxic_ssk as T


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def test_worst_passage():
    hits = np.zeros(5000)
    clean = T.worst(hits, np.full(5000, 6.0))
    hits[3210:3214] = 1
    assert T.worst(hits, np.full(5000, 6.0)) > clean + 3
    assert T.worst(hits[3210:3214], np.full(4, 6.0)) > T.worst(hits, np.full(5000, 6.0))
    assert T.worst(np.zeros(0), np.zeros(0)) == pytest.approx(np.log(0.25))
    long = "".join(chr(97 + k % 26) for k in range(1000))
    assert {w for p in T.pieces(long) for w in T.windows(p)} == set(T.windows(long))


def test_passage_in_long_clean_text(spark, tables):
    docs, labels = tables
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where("length(text) > 3000").orderBy("doc_id").limit(60).collect()]
    # Those that the machine leaves alone one by one; joined they are one long clean text.
    base = T.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(clean)], "doc_id long, text string")), labels)
    ok = {r.doc_id for r in base.where("doc_id < 0 AND predicted = 0").collect()}
    long = "\n".join(t for k, t in enumerate(clean) if -k - 1 in ok)
    half = len(long) // 2
    toxic = long[:half] + "\nyou idiot, you worthless trash, what a pathetic loser and scum\n" + long[half:]
    assert len(long) > 120_000
    got = T.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, long), (-2, toxic)], "doc_id long, text string")), labels)
    assert {r.doc_id: r.predicted for r in got.where(F.col("doc_id") < 0).collect()} == {-1: 0, -2: 1}
