import random

from tracequarry.plans.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(5, 5), (700, None), (900, 901), (901, 900)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, root(x)) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
