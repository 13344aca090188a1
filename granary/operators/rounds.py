"""Bounded retention with gossip, in rounds: nodes decide about their own rows and about the copies that peers send.

A round is one superstep: each node takes its rows of the round, then the copies sent to it in the round
before, in the order (sender, sequence number). What it admits goes to the peers drawn for the round. Rounds are
coarse on purpose: each costs one shuffle, and states and events are written to the shared folder, so that
lineage ends and lost executors cost one round at most. Parallelism is the number of nodes. A node's state, its
budget of rows with their vectors, must fit one task and, pickled, 2 GB; so must its offers of one round.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.gossip import peers
from granary.operators.stateful import finite_or_none, new_state
from granary.sources.tables import work_path

OFFER = "node int, src int, seq long, key long, vector array<float>, payload long, ttl int"
EVENT = f"{OFFER}, kind string, drop_cause string, evicted_key long, utility double, state binary"
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def superstep(mode: str, capacity: int, max_reps: int, balance: dict):
    """The step of one node: (its state, its offers) to an event per offer and a row with the new state."""

    def run(key: tuple, before: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        node = int(key[0])
        state = pickle.loads(before["state"].iloc[0]) if len(before) else new_state(mode, node, capacity, max_reps, **balance)
        remote = offers["src"] != node
        out = []
        for row in offers.assign(remote=remote).sort_values(["remote", "src", "seq", "key"]).itertuples(index=False):
            given = (node, row.src, row.seq, row.key, row.vector, row.payload, row.ttl)
            if row.remote and (row.vector is None or state.holds(int(row.key))):
                # versions come from the owner, so a stored copy is always as new
                out.append((*given, "DROPPED", "UTILITY" if row.vector is None else "DUPLICATE", None, None, None))
                continue
            d = state.offer(int(row.key), np.asarray(row.vector, np.float32))
            out.append((*given, d.kind, d.cause, d.evicted, finite_or_none(d.utility), None))
        out.append((node, None, None, None, None, None, None, "STATE", None, None, None, pickle.dumps(state)))
        whole = dict.fromkeys(("src", "seq", "key", "payload", "ttl", "evicted_key"), "Int64")
        return pd.DataFrame(out, columns=NAMES).astype(whole | {"utility": "float64"})

    return run


def simulate(
    items: DataFrame, mode: str, capacity: int, max_reps: int, nodes: int, fanout: int, number: Column, rounds: int = 8, ttl: int = 2, **balance: float
) -> tuple[DataFrame, DataFrame]:
    """(events, deliveries) of all nodes. ``items`` are (node, seq, key, vector, payload) with unique keys.

    ``number`` is the round of an item, 0 to ``rounds`` - 1. A copy goes ``ttl`` hops at most, so ``ttl`` rounds
    without own rows follow. Modes are ``random`` and ``utility``; full retention needs no state (``gossip.spread``).
    """
    if mode not in ("random", "utility"):
        raise ValueError(f"no rounds for mode {mode!r}")
    spark = items.sparkSession
    own = items.withColumn("round", number).select(F.col("node").cast("int").alias("node"), F.col("node").cast("int").alias("src"), "seq", "key", "vector", "payload", F.lit(ttl).alias("ttl"), "round")
    drawn = peers(spark, nodes, fanout, rounds + ttl) if nodes > 1 else None
    step = superstep(mode, capacity, max_reps, balance)
    state, arrived = spark.createDataFrame([], "node int, state binary"), spark.createDataFrame([], OFFER)
    events, sent = [], []
    for k in range(rounds + ttl if drawn is not None else rounds):
        offers = arrived.unionByName(own.where(F.col("round") == k).drop("round")) if k < rounds else arrived
        path = work_path(spark, f"round-{k}")
        # a node without offers keeps its state: its group is there on the side of states
        state.groupBy("node").cogroup(offers.groupBy("node")).applyInPandas(step, EVENT).write.parquet(path)
        done = spark.read.schema(EVENT).parquet(path)
        state = done.where("kind = 'STATE'").select("node", "state")
        decided = done.where("kind <> 'STATE'").drop("state")
        events.append(decided.drop("vector").withColumn("round", F.lit(k)))
        if drawn is None:
            continue
        left = F.when(F.col("src") == F.col("node"), F.col("ttl")).otherwise(F.col("ttl") - 1)
        outbox = decided.where("kind <> 'DROPPED'").withColumn("ttl", left).where("ttl > 0").select(F.col("node").alias("src"), "seq", "key", "vector", "payload", "ttl")
        here = drawn.where(F.col("epoch") == k).select("src", F.col("dst").alias("node"))
        arrived = outbox.join(F.broadcast(here), "src").select("node", "src", "seq", "key", "vector", "payload", "ttl")
        sent.append(arrived.select("src", F.col("node").alias("dst"), "key", "payload").withColumn("round", F.lit(k)))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(events), union(sent) if sent else spark.createDataFrame([], "src int, dst int, key long, payload long, round int")


def counters(events: DataFrame) -> DataFrame:
    """A row per node: offers seen, own ones, and what became of them."""
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    return events.groupBy("node").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("src") == F.col("node")).alias("own"), kind("ADMITTED", "EVICTED_AND_ADMITTED").alias("admitted"), kind("DROPPED").alias("dropped"),
        kind("EVICTED_AND_ADMITTED").alias("evicted"), F.count_if(F.col("drop_cause") == "DUPLICATE").alias("dropped_duplicate"), F.count_if(F.col("drop_cause") == "UTILITY").alias("dropped_utility"),
    )
