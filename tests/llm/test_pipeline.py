"""The pipeline against a brute-force version of its stages, on a small table."""

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from tracequarry.llm import byte_bpe
from tracequarry.llm.queries import vocabulary
from tests.llm.test_ngram_join import grams

EN = "the and that with for was this from have they said when over time people water long made first call".split()
FR = "le les dans une pour est que avec sont nous vous mais plus tout faire sans leur bien très après".split()


def rows():
    rng = random.Random(9)
    out = []
    for i in range(160):
        words = [rng.choice(FR if i % 4 == 0 else EN) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(rng.randint(12, 120))]
        out.append([i, " ".join(words), "fr" if i % 4 == 0 else "en", f"s{i % 5}" if i % 3 else "s0"])
    for i in range(160, 200):
        base = out[rng.randrange(0, 40)]
        words = base[1].split(" ")
        if i % 2 and len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        out.append([i, " ".join(words), base[2], f"s{i % 5}"])
    for i in range(200, 206):
        out.append([i, f"my token = live{i}abc9x7 stays with me and the people that said this over water number {i}", "en", "s1"])
        out.append([i + 10, f"your token = COPIED1example stays with the people of number {i} when they call for time", "en", f"s{i % 5}"])
    out += [[300, None, "en", "s1"], [301, "", "en", "s1"], [302, "123 456 ###", None, None], [303, "les gens dans une maison pour nous avec vous sans mais très bien", None, None]]
    rng.shuffle(out)
    return [(*r[:4], len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        out.append(docs.collect())
    return str(folder), out


def test_columns(stages):
    for rows_ in stages[1][:-1]:
        assert tuple(rows_[0].asDict()) == corpus_pipeline.COLUMNS


def test_language(stages):
    kept = {r.doc_id: r for r in stages[1][0]}
    assert set(kept) == {r[0] for r in rows()} - {300, 301, 302}
    assert all(kept[r[0]].text == r[1] and kept[r[0]].lang == (r[2] or "fr") and kept[r[0]].source == r[3] for r in rows() if r[0] in kept)


def test_near_duplicates(stages):
    before = sorted(stages[1][0], key=lambda r: r.doc_id)
    up = {r.doc_id: r.doc_id for r in before}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {r.doc_id: grams(r.text) for r in before}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = {root(i) for i in up}
    assert len(want) < len(up) - 20
    assert sorted(r.doc_id for r in stages[1][1]) == sorted(want)
    by = {r.doc_id: r for r in before}
    assert all(by[r.doc_id] == r for r in stages[1][1])


def test_secrets(stages):
    owners: dict = {}
    held: dict = {}
    for r in stages[1][1]:
        for v in re.findall(r"token = ([A-Za-z0-9+/_.=-]+)", r.text):
            owners.setdefault(v, set()).add(r.source)
            held.setdefault(v, set()).add(r.text)
    live = {v for v in owners if not (len(owners[v]) > 2 and len(held[v]) > 2 or len(held[v]) > 50)}

    def masked(text):
        return re.sub(r"(token = )([A-Za-z0-9+/_.=-]+)", lambda m: m[1] + ("[SECRET]" if m[2] in live else m[2]), text)

    assert live and set(owners) - live
    before, after = ({r.doc_id: r for r in stages[1][k]} for k in (1, 2))
    assert set(before) == set(after) and all(after[i].text == masked(before[i].text) and after[i].n_chars == len(after[i].text) for i in after)


def test_mixture(stages):
    from tests.llm.test_cube_mix import brute_targets

    size = lambda t: len(t.split())
    sizes, taken, times = {}, {}, {}
    for r in stages[1][2]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    by = {r.doc_id: r for r in stages[1][2]}
    for r in stages[1][3]:
        assert by[r.doc_id] == r
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = brute_targets(sizes)
    assert max(times.values()) <= 3 and all(abs(taken.get(s, 0) - want[s]) <= 120 for s in sizes)


def test_tokens(stages, spark):
    path, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in stages[1][3]}
    assert sorted(r.doc_id for r in stages[1][4]) == sorted(r.doc_id for r in stages[1][3])
    for r in stages[1][4]:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    again = corpus_pipeline.run(spark, stages[0]).collect()
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, again)) == sorted(map(key, stages[1][4]))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_repeated_rows_and_null_ids(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, None, "a", 1), (1, long, None, "a", 1), (None, long + " more", None, "b", 1), (None, "other words here", None, None, 1), (5, None, None, "a", 1), (6, "", None, "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, str(tmp_path)).count() == len(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, None, 5, 6} and any(r.doc_id == 1 for r in got)
