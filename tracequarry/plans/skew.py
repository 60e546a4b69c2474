"""Joins whose hot keys lie in no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this share of all, and than LEAST, is joined by broadcast: there are at most 1 / SHARE of them.
SHARE, LEAST = 0.001, 100


def join_split(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row a key and in `count` the key's rows in left; total is their sum.

    The few keys with very many rows are broadcast, so their rows stay where they are; the others are shuffled, none
    of them with more rows than the bound. left is read twice and should be stored or cheap. `count` is dropped.
    """
    bound = max(LEAST, int(total * SHARE))
    hot = right.where(F.col(count) > bound).drop(count)
    cold = right.where(F.col(count) <= bound).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
