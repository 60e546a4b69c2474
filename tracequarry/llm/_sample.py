"""Bounded samples of labelled rows that gather nothing unbounded in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.plans.shared import materialise

_RANGE = 1 << 40


def lowest_hash(rows: DataFrame, id_col: str, by: str, most: int) -> DataFrame:
    """(by, id) of at most `most` different ids in each group, those of lowest hash; fixed by the ids alone.

    The ids of the groups are counted first (approximately, repeats once), and every task then keeps only ids whose hash is below a bound that about twice
    `most` of them reach, so the window sees a few thousand rows however large a group is. (Fewer than `most` come
    back where a group has fewer, or with a chance below 1e-9 for `most` from 100 on.)
    """
    counted = materialise(rows.groupBy(F.col(by).alias("__by")).agg(F.greatest(F.approx_count_distinct(id_col), F.lit(1)).alias("__n")), "group_sizes")
    drawn = F.pmod(F.xxhash64(id_col), F.lit(_RANGE))
    share = F.least(F.lit(1.0), (F.lit(2.0 * most + 100)) / F.col("__n"))
    near = rows.select(F.col(by), F.col(id_col), drawn.alias("__h")).join(counted, F.col(by).eqNullSafe(F.col("__by"))).where(F.col("__h") < F.ceil(share * _RANGE))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__h", id_col))
    return near.select(by, id_col, "__h").distinct().withColumn("__r", rank).where(F.col("__r") <= most).select(by, id_col)
