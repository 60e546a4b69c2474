"""Against a comparison with every template, and planted licences."""

import random

import pytest

from tracequarry.llm import license_dice as D


def brute(text):
    hits = []
    for begin, end, words in D.units(text or ""):
        own = set(zip(words, words[1:]))
        best = None
        for name, t in D.TEMPLATES:
            w = D.normal_words(t)
            other = set(zip(w, w[1:]))
            dice = 2 * len(own & other) / (len(own) + len(other)) if own or other else 0
            if dice >= 0.8 and (best is None or dice > best[1]):
                best = (name, dice)
        if best:
            hits.append((-best[1], begin, end, best[0]))
    if not hits:
        return None, 0.0, None, None, 0, []
    top = min(hits)
    return top[3], -top[0], top[1], top[2] - 1, len(hits), sorted({h[3] for h in hits})


def texts():
    rng = random.Random(6)
    out = [None, "", "\n\n", "license", "x" * 100_000, "Mit licensed under nothing at all"]
    for name, t in D.TEMPLATES:
        words = t.split(" ")
        out += [t, t.upper().replace("LICENSE", "LICENCE"), "prose before\n" + t + "\nprose after", "above\n\n" + t + "\n\nbelow is much more text " * 3]
        for _ in range(3):
            w = list(words)
            for _ in range(rng.randint(1, max(1, len(w) // 4))):
                w[rng.randrange(len(w))] = "zzz"
            out.append(" ".join(w))
    return out


def test_rows_equal_brute_force(spark):
    found = texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(found)] + [(None, found[6], "c"), (3, found[3], "c")], "doc_id long, text string, licence string")
    got = D.scan(docs).collect()
    assert len(got) == len(found) + 2
    for r in got:
        want = brute(found[6 if r.doc_id is None else r.doc_id])
        assert (r.licence, r.first_line, r.last_line, r.n_hits, r.licences) == (want[0], *want[2:]) and abs(r.dice - want[1]) < 1e-12
    assert D.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name,template", D.TEMPLATES)
def test_each_template_is_found_in_prose(name, template):
    m = D.Matcher(D.TEMPLATES, D.THRESHOLD)
    assert m.best(D.normal_words(template))[:2] == (name, 1.0)
    hits = [m.best(w) for _, _, w in D.units("some words\n\n" + template + "\n\nother words")]
    assert name in {h[0] for h in hits if h}


def test_size_bounds_only_prune():
    m = D.Matcher(D.TEMPLATES, D.THRESHOLD)
    for s, (low, high) in zip(m.sets, m.bounds):
        for n in range(1, 3 * len(s)):
            if 2 * min(n, len(s)) / (n + len(s)) >= D.THRESHOLD:
                assert low <= n <= high


def test_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id for r in docs.where("text like '%Licensed under CC BY-NC 4.0.%' or text like '%Released under the MIT License.%' or text like '%Licensed under the Apache License, Version 2.0.%' or text like '%GNU General Public License, version 3.%'").collect()}
    got = {r.doc_id for r in D.scan(docs).where("licence is not null").collect()}
    assert want and got == want
