"""Targets against the stated loop, the cube's invariants, and nearness to the targets."""

import random
import re

import pytest

from tracequarry.llm import cube_mix as C


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in above}


def test_steps_keep_totals_and_averages():
    rng = random.Random(1)
    for _ in range(200):
        p, sizes = [rng.uniform(0.01, 0.99) for _ in range(3)], [rng.choice([0, 1, 5, 5, 900]) for _ in range(3)]
        v = C.null_vector(sizes)
        assert abs(sum(v)) < 1e-9 and abs(sum(a * b for a, b in zip(v, sizes))) < 1e-6
        ends = [C.move(p, v, d / 1000) for d in range(1000)]
        for q in ends:
            assert any(x in (0.0, 1.0) for x in q) and all(0 <= x <= 1 for x in q)
            assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, sizes)) - sum(a * b for a, b in zip(p, sizes))) < 1e-5
        assert all(abs(sum(q[k] for q in ends) / 1000 - p[k]) < 0.002 for k in range(3))


def test_flight_leaves_at_most_two():
    rng = random.Random(2)
    out = []
    flight = C.Flight(lambda row, p: out.append((row, p)))
    sizes = [rng.randint(0, 1000) for _ in range(5000)]
    for i, s in enumerate(sizes):
        flight.add(i, s, 0.37, i)
        assert len(flight.open) <= 2
    flight.land()
    assert sorted(r for r, _ in out) == list(range(5000)) and all(p in (0.0, 1.0) for _, p in out)
    assert abs(sum(p for _, p in out) - 0.37 * 5000) < 2 and abs(sum(sizes[r] * p for r, p in out) - 0.37 * sum(sizes)) < 1500


def rows():
    rng = random.Random(3)
    out = []
    for i in range(3000):
        source = rng.choice(["a", "a", "a", "a", "B", "é", None, "tiny"]) if i % 40 else "zero"
        if source == "tiny" and i % 9:
            source = "a"
        text = None if i % 97 == 0 else "" if i % 89 == 0 or source == "zero" else " \n".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 60)))
        out.append((None if i % 60 == 0 else i // 2 * 2 if i % 10 == 0 else i, text, source, "clash", 1))
    return out


@pytest.mark.parametrize("block", [4096, 64, 16])
def test_mix(spark, block):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string, target int")
    got = C.mix(docs, block=block).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, str(r.source)) for r in got) == sorted(((i is None, i or 0), size(t), str(s)) for i, t, s, *_ in data)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and int(ratio + 1e-9) <= r.copies <= int(ratio + 1e-9) + 1 and r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, (s, taken[s], want[s])
    again = C.mix(docs.repartition(5), block=block).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in C.mix(docs).collect()] == [(0, 0.0, 0)]
    assert C.mix(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "a b", "s") for i in range(4)], "doc_id long, text string, source string")
    assert sum(r.taken for r in C.mix(one).collect()) == 8


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 5), f"s{i % 3}", "x", 1, 2, 3) for i in range(50)], "doc_id long, text string, source string, target string, whole int, part int, __row int")
    got = C.mix(docs, keep=("text", "target", "whole", "part", "__row"))
    assert got.columns.count("target") == 1 and dict(got.dtypes)["target"] == "double"
    assert {(r.whole, r.part, r["__row"]) for r in got.collect()} == {(1, 2, 3)}


def test_decisions_by_broadcast_and_by_shuffle(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string").repartition(4, "doc_id")
    one, two = (sorted((r.doc_id, r.copies, r.text) for r in C.mix(docs, keep=("text",), marked=m).collect()) for m in (C.MARKED, 0))
    assert one == two and {c for _, c, _ in one} > {0}
