"""Global orders without a task that holds all rows: running sums over range partitions, the n-th smallest hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.sources.scratch import written

#: Hex digits by which hashes are counted to find a cut: 16 ** PREFIX counts come to the driver at most.
PREFIX = 3


def running_sums(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with `<column>_before`: the sum of the column over all rows earlier in the order (0 for the first).

    Rows go into range partitions that are written once; sums run within each, offsets come from one row a partition.
    Rows that are equal in `order` are in no certain order among themselves.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__part").agg(*[F.sum(c).alias(c) for c in columns])
    # one row a partition
    ahead = upto.orderBy("__part")
    offsets = sums.select(F.col("__part"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}") for c in columns])
    within = upto.partitionBy("__part").orderBy(*order)
    got = parts.join(F.broadcast(offsets), "__part")
    return got.select(*df.columns, *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in columns])


def nth_smallest(df: DataFrame, column: Column, n: int) -> str | None:
    """The n-th smallest (from 1) of a column of hex digests; the largest if there are fewer, None if there are none or n < 1.

    Digests are counted by their first digits; only those with the digits at the cut are sorted.
    """
    keys = df.select(column.alias("h")).filter("h is not null")
    counts = sorted((r.p, r["count"]) for r in keys.groupBy(F.substring("h", 1, PREFIX).alias("p")).count().collect())
    if not counts or n < 1:
        return None
    before = 0
    for prefix, count in counts:
        if before + count >= n or prefix == counts[-1][0]:
            here = keys.filter(F.substring("h", 1, PREFIX) == prefix).orderBy("h").limit(min(count, n - before))
            return here.agg(F.max("h")).first()[0]
        before += count
    return None
