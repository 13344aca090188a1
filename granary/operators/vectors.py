"""Nearest representatives, bins and utilities.

Representatives of a node are a bounded set (at most ``REPS_LIMIT``, checked). ``size`` is a bound of all of them in
bytes, as ``bytes_of`` gives it from settings; up to ``SMALL`` they are broadcast, so that items are not shuffled by
their few nodes. Beyond it, or without a bound, items meet them by an equi-join on the node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.expr import finite, l2, rep_utility, store_utility, target_load
from granary.operators.retention import placed, utility_bucket

REPS_LIMIT = 4096
SMALL = 64 << 20


def bytes_of(nodes: int, per_node: int, dim: int) -> int:
    """A bound of the representatives of all nodes in bytes, keys and overheads included."""
    return nodes * per_node * (4 * dim + 64)


def small(df: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(df) if size is not None and size <= SMALL else df


def representatives(items: DataFrame, per_node: int) -> DataFrame:
    """The first ``per_node`` items of each node by key."""
    if not 1 <= per_node <= REPS_LIMIT:
        raise ValueError(f"{per_node} representatives; at most {REPS_LIMIT}")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    return items.withColumn("rep_rank", rank).where(F.col("rep_rank") <= per_node).select("node", "key", "vector", "rep_rank")


def two_nearest(items: DataFrame, reps: DataFrame, size: int | None = None) -> DataFrame:
    """``items`` with k1, d1, k2, d2: the two nearest representatives of its node other than itself; earlier ones win ties."""
    packed = reps.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rep_rank", "key", "vector"))).alias("reps"))
    near = F.array_sort(
        F.filter(
            F.transform(F.filter("reps", lambda r: r["key"] != F.col("key")), lambda r: F.struct(l2(F.col("vector"), r["vector"]).alias("d"), r["rep_rank"].alias("rank"), r["key"].alias("k"))),
            lambda x: finite(x["d"]).isNotNull(),
        )
    )
    return items.join(small(packed, size), "node").withColumn("near", near).select(
        *items.columns, F.get("near", F.lit(0))["k"].alias("k1"), F.get("near", F.lit(0))["d"].alias("d1"), F.get("near", F.lit(1))["k"].alias("k2"), F.get("near", F.lit(1))["d"].alias("d2")
    )


def non_reps(items: DataFrame, reps: DataFrame, size: int | None = None) -> DataFrame:
    return items.join(small(reps.select("node", "key"), size), ["node", "key"], "left_anti")


def bins(scored: DataFrame) -> DataFrame:
    """(node, k1, load, sum and mean distance) of the items nearest to each representative."""
    return scored.groupBy("node", "k1").agg(F.count(F.lit(1)).alias("load"), F.sum("d1").alias("sum_distance"), F.avg("d1").alias("mean_distance"))


def utilities(scored: DataFrame, binned: DataFrame, capacity: int, per_node: int, gamma: float = 1.0, lo: float = 0.5, hi: float = 2.0, size: int | None = None) -> DataFrame:
    """``scored`` with the utility of storing each item. Bins are no more than representatives."""
    active = binned.groupBy("node").agg(F.count(F.lit(1)).alias("bins"))
    joined = scored.join(small(binned.select("node", "k1", "load", "mean_distance"), size), ["node", "k1"], "left").join(small(active, size), "node", "left")
    target = target_load(F.lit(capacity), F.lit(per_node), F.coalesce("bins", F.lit(1)))
    return joined.withColumn("utility", store_utility(F.col("d1"), F.coalesce("load", F.lit(0)), F.col("mean_distance"), target, gamma, lo, hi)).drop("load", "mean_distance", "bins")


def rep_utilities(reps: DataFrame) -> DataFrame:
    """(node, key, utility) of the representatives, from each other."""
    return two_nearest(reps.drop("rep_rank"), reps).select("node", "key", "d1", "d2", rep_utility(F.col("d1"), F.col("d2")).alias("utility"))


def keep_best(scored: DataFrame, room: int) -> DataFrame:
    """The ``room`` items of highest finite utility of each node, smaller keys first on ties, with their ``rank``."""
    sound = scored.where(finite(F.col("utility")).isNotNull())
    return placed(sound, "node", utility_bucket(F.col("utility")), F.desc("utility"), "key", most=room).withColumnRenamed("place", "rank")
