"""Order-free retention: everything, or the first rows of each node in some order - random, or by utility.

Nodes are few, so a sort of each node would give a cluster as many tasks as there are nodes. Rows are counted
in buckets instead, which follow the order: whole buckets that fit a budget are kept as they are scanned, and only
the bucket at the edge of a budget is sorted. Counts of buckets are at most nodes times buckets, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.expr import dice

SEED = 1337
HEX = 3
#: Buckets of utilities; their logarithms' resolution is 1 / ``FINE``.
MOST, FINE = 1 << 15, 1024


def mixed_bucket(mixed: Column) -> Column:
    """One of 4096 buckets by the first digits of a hexadecimal hash."""
    return F.conv(F.substring(mixed, 1, HEX), 16, 10).cast("int")


def utility_bucket(utility: Column) -> Column:
    """Buckets of finite utilities from 0, the highest utilities first."""
    return (MOST - 1 - F.least(F.floor(F.log1p(F.greatest(utility, F.lit(0.0))) * FINE), F.lit(MOST - 1))).cast("int")


def marks(df: DataFrame, group: str) -> DataFrame:
    """(group, __bucket, __n, __before): rows of each bucket and of those before it in its group."""
    counts = df.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    return counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__bucket")) - F.col("__n"))


def placed(df: DataFrame, group: str, bucket: Column, *order: str | Column, most: int | None = None) -> DataFrame:
    """``df`` with ``place``, from 1, of each row in its group, up to ``most``. Tasks sort buckets, not groups; groups are bounded in number."""
    own = df.withColumn("__bucket", bucket)
    told = marks(own, group).drop("__n")
    told = told if most is None else told.where(F.col("__before") < most)
    inside = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order))
    found = own.join(F.broadcast(told), [group, "__bucket"]).withColumn("place", F.col("__before") + inside).select(*df.columns, "place")
    return found if most is None else found.where(F.col("place") <= most)


def first_rows(df: DataFrame, group: str, bucket: Column, quota: int | DataFrame, *order: str | Column, bounded: bool = True) -> DataFrame:
    """The first rows of each group: ``quota`` of them, or as many as its row of ``quota`` (group, quota) says.

    Nothing but the bucket at each group's edge is shuffled. ``bounded`` groups are few, and their marks are broadcast.
    """
    own = df.withColumn("__bucket", bucket)
    told = marks(own, group)
    told = told.withColumn("__quota", F.lit(quota).cast("long")) if isinstance(quota, int) else told.join(quota.select(group, F.col("quota").alias("__quota")), group)
    told = told.where(F.col("__before") < F.col("__quota"))
    met = own.join(F.broadcast(told) if bounded else told, [group, "__bucket"])
    fits = F.col("__before") + F.col("__n") <= F.col("__quota")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    edge = met.where(~fits).withColumn("__in", place).where(F.col("__before") + F.col("__in") <= F.col("__quota"))
    return met.where(fits).select(*df.columns).unionByName(edge.select(*df.columns))


def mixed_items(items: DataFrame) -> DataFrame:
    return items.withColumn("__mixed", dice(F.lit(SEED), F.col("node"), F.col("key")))


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with their place in their node's random order; budgets of any size are prefixes of it."""
    return placed(mixed_items(items), "node", mixed_bucket(F.col("__mixed")), "__mixed", "key").drop("__mixed")


def uniform(items: DataFrame, budget: int) -> DataFrame:
    """A uniform sample of ``budget`` keys of each node."""
    return first_rows(mixed_items(items), "node", mixed_bucket(F.col("__mixed")), budget, "__mixed", "key").drop("__mixed")
