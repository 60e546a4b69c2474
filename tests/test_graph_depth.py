"""Betweenness counts paths of any length."""

from tracequarry.operators import graph


def test_long_chain(spark):
    n = 53
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(n - 1)], "src string, dst string").coalesce(1)
    got = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert all(abs(got[f"n{k:02}"] - k * (n - 1 - k) / ((n - 1) * (n - 2))) < 1e-9 for k in range(n))
