"""Positions in large groups without one task per group.

Rows of a group are dealt by a hash into buckets of a few hundred rows.  The buckets' totals
are written out once and summed up on two levels; only the rows of one bucket are ever
ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 500


def bucket_count(rows: int) -> int:
    return max(1, rows // BUCKET_ROWS)


def sum_before(column: str, by: list[str], *order: Column | str) -> Column:
    """The sum of `column` over the rows that stand before in the same window."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0)).cast("long")


def bucket_offsets(sums: DataFrame, group: list[str], bucket: str, value: str, buckets: int, out: str) -> DataFrame:
    """`sums` (one row per group and bucket) with `out`: the sum of `value` over the group's earlier buckets.

    `sums` is read twice, so it must be cheap to read.  The group columns are compared null-safely.
    """
    wide = max(1, int(buckets**0.5))
    dealt = sums.withColumn("_wide", F.floor(F.col(bucket) / wide))
    tops = dealt.groupBy(*group, "_wide").agg(F.sum(value).alias("_top"))
    tops = tops.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_wide").alias("_of_wide"), sum_before("_top", group, "_wide").alias("_above"))
    same = F.col("_wide") == F.col("_of_wide")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    inner = dealt.withColumn(out, sum_before(value, [*group, "_wide"], bucket))
    return inner.join(tops, same).withColumn(out, F.col(out) + F.col("_above")).drop("_wide", "_above", "_of_wide", *[f"_of_{g}" for g in group])
