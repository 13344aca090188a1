"""Peers, batches and the spread of kept rows between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.expr import dice


def pairs(spark: SparkSession, nodes: int) -> DataFrame:
    """(src, dst) of a complete overlay; nodes are at most 36."""
    return spark.range(nodes * nodes).select(F.floor(F.col("id") / nodes).cast("int").alias("src"), (F.col("id") % nodes).cast("int").alias("dst")).where("src <> dst")


def peers(spark: SparkSession, nodes: int, fanout: int, epochs: int) -> DataFrame:
    """(epoch, src, dst): the ``fanout`` peers that each node draws for each epoch."""
    every = pairs(spark, nodes).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rank = F.row_number().over(Window.partitionBy("epoch", "src").orderBy(dice(F.col("epoch"), F.col("src"), F.col("dst")), "dst"))
    return every.withColumn("r", rank).where(F.col("r") <= fanout).select("epoch", "src", "dst")


def deliver(outbox: DataFrame, drawn: DataFrame) -> DataFrame:
    """A copy of each row of the outbox (src, epoch, ...) for each drawn peer, with one hop less to go."""
    return outbox.join(F.broadcast(drawn), ["epoch", "src"]).withColumn("ttl", F.col("ttl") - 1)


def first_copies(arrived: DataFrame) -> DataFrame:
    """One row per (dst, key): the copy of the smallest sender."""
    return arrived.groupBy("dst", "key").agg(F.min("src").alias("src"), F.max("ttl").alias("ttl"), F.min("epoch").alias("epoch"), F.first("payload").alias("payload"))


def spread(owned: DataFrame, drawn: DataFrame, ttl: int = 2) -> tuple[DataFrame, DataFrame]:
    """(deliveries, holders) of full retention: each row (node, key, epoch, payload) goes out ``ttl`` hops.

    A node forwards a key once, from the first copy that it gets; the owner never gets its own row as new.
    """
    holders = owned.select(F.col("node").alias("dst"), "key")
    outbox, sent = owned.select(F.col("node").alias("src"), "key", "epoch", "payload", F.lit(ttl).alias("ttl")), None
    for _ in range(ttl):
        arrived = deliver(outbox, drawn)
        sent = arrived if sent is None else sent.unionByName(arrived)
        fresh = first_copies(arrived.join(holders, ["dst", "key"], "left_anti"))
        holders = holders.unionByName(fresh.select("dst", "key"))
        outbox = fresh.where("ttl > 0").select(F.col("dst").alias("src"), "key", "epoch", "payload", "ttl")
    return sent, holders


def cycle(view: DataFrame, view_size: int) -> DataFrame:
    """One round of peer sampling on (src, dst, age): ages grow, each node swaps views with its oldest peer.

    A view keeps each peer's smallest age, never itself, and when too large its oldest entries.
    """
    aged = view.withColumn("age", F.col("age") + 1)
    partner = aged.groupBy("src").agg(F.max_by("dst", F.struct("age", (-F.col("dst")).alias("m"))).alias("partner"))
    own = partner.select(F.col("partner").alias("to"), F.col("src").alias("dst"), F.lit(0).alias("age"))
    given = aged.join(partner, "src").select(F.col("partner").alias("to"), "dst", "age").unionByName(own)
    back = partner.join(aged.withColumnRenamed("src", "partner"), "partner").select(F.col("src").alias("to"), "dst", "age")
    every = aged.withColumnRenamed("src", "to").unionByName(given).unionByName(back).where("`to` <> dst")
    merged = every.groupBy(F.col("to").alias("src"), "dst").agg(F.min("age").alias("age"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("age"), "dst"))
    return merged.withColumn("r", rank).where(F.col("r") <= view_size).drop("r")


def newer(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Arrivals (node, key, version) of which the node has no copy as new."""
    held = stored.select("node", "key", F.col("version").alias("held"))
    return incoming.join(held, ["node", "key"], "left").where(F.col("held").isNull() | (F.col("held") < F.col("version"))).drop("held")
