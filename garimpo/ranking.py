"""Global ranks without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _BEFORE = "_rk_bucket", "_rk_before"


def permuted_rank(df: DataFrame, group: list[str], key: Column, rank: str = "rank", buckets: int = 256) -> DataFrame:
    """Dense ranks 1..n of each group in the order of a permuted (hashed) key.

    A plain window would put a whole group into one task. Here the 64-bit key is cut
    into `buckets` ranges: one small table holds the number of rows of each (group,
    range), its running sum gives every range its offset, and only the rows of one
    range of one group are sorted together. A group that holds a third of all rows is
    thus spread over `buckets` tasks. Rows with equal keys keep distinct, consecutive
    ranks, so n rows always get the ranks 1..n.
    """
    width = (1 << 64) // buckets
    keyed = df.withColumn("_rk_key", key).withColumn(
        _BUCKET, F.floor((F.col("_rk_key").cast("double") + F.lit(float(1 << 63))) / F.lit(float(width))).cast("int")
    )
    sizes = keyed.groupBy(*group, _BUCKET).agg(F.count(F.lit(1)).alias("_rk_n"))
    running = Window.partitionBy(*group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_rk_{g}") for g in group],
        F.col(_BUCKET).alias("_rk_b"),
        F.coalesce(F.sum("_rk_n").over(running), F.lit(0)).alias(_BEFORE),
    )
    within = Window.partitionBy(*group, _BUCKET).orderBy("_rk_key")
    ranked = keyed.withColumn("_rk_in", F.row_number().over(within))
    same = [F.col(g).eqNullSafe(F.col(f"_rk_{g}")) for g in group] + [F.col(_BUCKET) == F.col("_rk_b")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return ranked.join(offsets, condition).withColumn(rank, (F.col("_rk_in") + F.col(_BEFORE)).cast("long")).drop(
        "_rk_key", _BUCKET, "_rk_b", _BEFORE, "_rk_in", *[f"_rk_{g}" for g in group]
    )
