"""Running sums in an order that may be longer than one task should hold. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which each group's order is cut at least, and rows of one bucket beyond that: if one group has all rows, a window still holds no more.
BUCKETS, BUCKET_ROWS = 256, 200_000


def buckets(rows: int) -> int:
    """The buckets for a table of so many rows."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of the same group that come before.

    ``bucket`` (a number, of about ``buckets`` values) must not fall along the order. The sums of the
    buckets are added up first, then the rows of each bucket: a window holds one
    bucket of one group, or one row for each bucket.
    """
    rows = df.withColumn("_b", bucket.cast("int"))
    sums = rows.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    same = F.col("_b") == F.col("_gb")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    # one row for each bucket of each group: beyond the broadcast threshold Spark joins by group and bucket, as the windows are dealt
    return own.join(base, same).withColumn(out, F.col("_base") + F.col("_in")).select(*df.columns, out)
