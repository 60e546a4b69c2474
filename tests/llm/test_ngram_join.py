"""Classes and links against all pairs, and the pruning rule against its definition."""

import random
import re

import numpy as np
import pytest

from tracequarry.llm import ngram_join as J


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 6, 40, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    out += [" ".join(shared + [word() for _ in range(rng.choice([20, 60, 200]))]) for _ in range(15)]
    base = [word() for _ in range(80)]
    out += [" ".join([*base, word()]) for _ in range(40)]
    out += [out[0]] * 5 + [out[3]] * 3 + ["", "", " ", "\n", None, None, "é日", "é日"]
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_classes_and_links(spark, block):
    texts = corpus()
    rng = random.Random(5)
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in zip(ids, texts)], "doc_id long, text string, class_id string, n_links int").repartition(3)
    got = {r.doc_id: r for r in J.jaccard_classes(docs, block=block).collect()}
    assert len(got) == len(texts)
    sets = {t: grams(t) for t in texts if t is not None}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = {}
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] = links.get(a, 0) + 1
    for i, t in zip(ids, texts):
        for j, s in zip(ids, texts):
            if t is not None and s is not None and (t == s or sets[t] and sets[s] and 10 * len(sets[t] & sets[s]) >= 8 * len(sets[t] | sets[s])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    for i, t in zip(ids, texts):
        assert got[i].class_id == root(i)
        assert got[i].n_links == links.get(t, 0)
        assert got[i].n_copies == (1 if t is None else texts.count(t))
    kept = J.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({root(i) for i in ids})
    assert set(kept[0].asDict()) == set(docs.columns)


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long + " x"), (None, "other words are here now"), (7, "other words are here now"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in J.jaccard_classes(docs).collect())
    assert got == sorted([("1", "1", 1, 2), ("1", "1", 1, 2), ("None", "1", 1, 1), ("None", "7", 0, 2), ("7", "7", 0, 2), ("None", "None", 0, 1)])
    assert J.one_of_each(docs).count() == 3
    assert J.jaccard_classes(docs.limit(0)).count() == 0


def test_pruning_rule():
    # Against numerical integration of s**m (1 - s)**(n - m).
    s = np.linspace(0, 1, 200_001)
    for n, m in ((16, 8), (16, 15), (64, 40), (128, 100)):
        law = s**m * (1 - s) ** (n - m)
        assert abs(J.posterior(m, n, 0.8) - law[s >= 0.8].sum() / law.sum()) < 1e-3
    least = J.least_agreeing(0.8, 1e-6)
    assert len(least) == 8 and all(J.posterior(m, 16 * k, 0.8) >= 1e-6 for k, m in enumerate(least, 1))
    assert all(m == 0 or J.posterior(m - 1, 16 * k, 0.8) < 1e-6 for k, m in enumerate(least, 1))


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
        x, y = J.minhash(np.concatenate((common, a))), J.minhash(np.concatenate((common, b)))
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_clashing_names_and_copies(spark):
    long = " ".join(f"w{i}" for i in range(50))
    names = "doc_id long, text string, same string, id int, key int, m int, node int, `__same` string, `__id` int"
    docs = spark.createDataFrame([(i, long, "x", 1, 2, 3, 4, "y", 5) for i in range(1500)] + [(9999, None, "x", 1, 2, 3, 4, "y", 5)], names)
    got = J.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 9999]
    # More copies than are joined by a shuffle.
    assert {(r.class_id, r.n_links, r.n_copies) for r in J.jaccard_classes(docs).collect()} == {(0, 0, 1500), (9999, 0, 1)}


def test_texts_without_candidates_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(1000)], "id long, same string")
    few = docs.where("id % 100 = 0")
    kept = {r.id for r in J._only(docs, few).collect()}
    assert kept >= {r.id for r in few.collect()} and len(kept) < 20
