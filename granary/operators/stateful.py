"""Sequential retention: the per-node state machine and its batch form.

A node's state is bounded by its budget; its rows pass by as a sorted stream, so no task holds them.
Parallelism is the number of nodes (at most 36). The order-free forms have no such bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROMOTE = 1.10
BOOTSTRAP = 8
LEAST_MEAN = 1e-9


@dataclass
class Bin:
    load: int = 0
    total: float = 0.0


@dataclass
class Item:
    """``utility`` is that of storing it; ``rank`` its utility as a representative; the second nearest representative stands in when the nearest goes."""

    vector: np.ndarray
    utility: float
    near: int | None = None
    distance: float = 0.0
    rank: float = np.inf
    second: int | None = None
    second_distance: float = np.inf


@dataclass
class Decision:
    kind: str
    cause: str | None = None
    evicted: int | None = None
    utility: float = 0.0
    rep_change: bool = False


def distances(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Euclidean distances over common lengths, in doubles; infinite where an element that counts is not finite."""
    if len({len(v), *map(len, others)}) == 1:
        d = np.sqrt(((np.array(others, np.float64) - v.astype(np.float64)) ** 2).sum(axis=1))
    else:
        d = np.array([np.sqrt(((o[: len(v)].astype(np.float64) - v[: len(o)]) ** 2).sum()) for o in others])
    d[~np.isfinite(d)] = np.inf
    return d


@dataclass
class UtilityNode:
    """A node that keeps novel and under-represented items around a small ordered set of representatives."""

    capacity: int
    max_reps: int
    gamma: float = 1.0
    lo: float = 0.5
    hi: float = 2.0
    reps: dict[int, Item] = field(default_factory=dict)
    others: dict[int, Item] = field(default_factory=dict)
    bins: dict[int, Bin] = field(default_factory=dict)
    #: (utility, key) of items that are no representatives; entries outlive their items and are passed over.
    heap: list[tuple[float, int]] = field(default_factory=list)
    #: The representatives' keys and vectors as a matrix, or the vectors as a list where lengths differ; None after a change.
    slots: tuple | None = None

    def slot_distances(self, v: np.ndarray, but: int | None) -> tuple[list[int], np.ndarray]:
        """(keys, distances of ``v``) of the representatives other than ``but``, in their order."""
        if self.slots is None:
            vectors = [r.vector for r in self.reps.values()]
            alike = len({len(x) for x in vectors}) == 1
            self.slots = list(self.reps), np.array(vectors, np.float64) if alike else vectors
        keys, vectors = self.slots
        if isinstance(vectors, list) or vectors.shape[1] != len(v):
            d = distances(v, list(vectors))
        else:
            d = np.sqrt(((vectors - v.astype(np.float64)) ** 2).sum(axis=1))
            d[~np.isfinite(d)] = np.inf
        if but in self.reps:
            at = keys.index(but)
            keys, d = keys[:at] + keys[at + 1 :], np.delete(d, at)
        return keys, d

    def two_nearest(self, key: int | None, v: np.ndarray) -> tuple[int | None, float, int | None, float]:
        """The nearest and the second nearest representative other than ``key``, with their distances; earlier ones win ties."""
        keys, d = self.slot_distances(v, key) if self.reps else ([], np.zeros(0))
        if not len(keys):
            return None, np.inf, None, np.inf
        order = np.argsort(d, kind="stable")[:2]
        found = [(keys[j], float(d[j])) if np.isfinite(d[j]) else (None, np.inf) for j in order] + [(None, np.inf)]
        return *found[0], *found[1]

    def nearest(self, key: int | None, v: np.ndarray) -> tuple[int | None, float, float]:
        """(nearest representative other than ``key``, its distance, the second distance)."""
        first, d1, _, d2 = self.two_nearest(key, v)
        return first, d1, d2

    def keep(self, key: int, item: Item) -> None:
        """Put an item that is no representative, or has a new utility, where ``worst`` finds it."""
        self.others[key] = item
        heapq.heappush(self.heap, (item.utility, key))
        if len(self.heap) > 64 + 4 * len(self.others):
            self.heap = [(x.utility, k) for k, x in self.others.items()]
            heapq.heapify(self.heap)

    def worst(self, but: int | None = None) -> int | None:
        """The key of the least (utility, key) among items that are no representatives, other than ``but``."""
        held, found = None, None
        while self.heap:
            utility, key = self.heap[0]
            item = self.others.get(key)
            if item is None or item.utility != utility:
                heapq.heappop(self.heap)
            elif key == but:
                held = heapq.heappop(self.heap)
            else:
                found = key
                break
        if held:
            heapq.heappush(self.heap, held)
        return found

    def store_utility(self, near: int | None, d: float) -> float:
        if not np.isfinite(d):
            return np.inf
        d = max(0.0, d)
        if near is None or near not in self.bins:
            return d
        b = self.bins[near]
        mean = max(LEAST_MEAN, b.total / b.load if b.load else 0.0)
        target = max(1.0, max(0, self.capacity - len(self.reps)) / max(1, len(self.bins)))
        return d / mean * min(self.hi, max(self.lo, ((target + 1) / (b.load + 1)) ** self.gamma))

    @staticmethod
    def rep_utility(d1: float, d2: float) -> float:
        if not np.isfinite(d1):
            return np.inf
        return np.log1p(max(0.0, d1)) * (1 + 0.25 * min(1.0, max(0.0, d1 / d2)) if np.isfinite(d2) and d2 > 0 else 1.0)

    def least_rep(self) -> float:
        found = [r.rank for r in self.reps.values() if np.isfinite(r.rank)]
        return min(found) if found else 0.0

    def holds(self, key: int) -> bool:
        return key in self.reps or key in self.others

    def snapshot(self) -> tuple[int, float, float, int, float, float]:
        """(stored rows, their utility, least utility of one that is no representative, representatives, their least and mean utility)."""
        ranks = [r.rank for r in self.reps.values() if np.isfinite(r.rank)]
        every = [x.utility for side in (self.reps, self.others) for x in side.values() if np.isfinite(x.utility)]
        least = min((x.utility for x in self.others.values()), default=0.0)
        return len(self.reps) + len(self.others), float(sum(every)), float(least), len(self.reps), self.least_rep(), float(np.mean(ranks)) if ranks else 0.0

    def offer(self, key: int, v: np.ndarray) -> Decision:
        if self.capacity == 0:
            return Decision("DROPPED", "UTILITY")
        if self.holds(key):
            raise ValueError(f"key {key} is stored already; keys must be unique")
        if self.reps:
            near, d1, second, d2 = self.two_nearest(key, v)
            utility, as_rep = self.store_utility(near, d1), self.rep_utility(d1, d2)
            if not np.isfinite(utility):
                return Decision("DROPPED", "UTILITY", utility=utility)
        else:
            near, d1, second, d2, utility, as_rep = None, np.inf, None, np.inf, np.inf, np.inf
        full = len(self.reps) + len(self.others) >= self.capacity
        promote = len(self.reps) < min(BOOTSTRAP, self.capacity, self.max_reps) or not self.reps or as_rep > PROMOTE * self.least_rep()
        item, evicted = Item(v, utility, near, d1, second=second, second_distance=d2), None
        if full and not self.others:
            return Decision("DROPPED", "UTILITY", utility=utility)
        if not promote:
            if full:
                worst = self.worst()
                if utility <= self.others[worst].utility:
                    return Decision("DROPPED", "UTILITY", utility=utility)
                evicted = worst
                self._leave(self.others.pop(worst))
            self.keep(key, item)
            self._join(item)
        else:
            evicted = self._promote(key, item, as_rep, full)
        return Decision("ADMITTED" if evicted is None else "EVICTED_AND_ADMITTED", None, evicted, utility, key in self.reps)

    def _promote(self, key: int, item: Item, as_rep: float, full: bool) -> int | None:
        demoted, evicted = None, None
        if len(self.reps) >= self.max_reps:
            rank = lambda k: self.reps[k].rank if np.isfinite(self.reps[k].rank) else -np.inf
            demoted = min(self.reps, key=rank)  # the earliest one of equals
            if (as_rep if np.isfinite(as_rep) else 0.0) <= rank(demoted):
                if full:
                    raise AssertionError("a promotion at a full node has a better rank than the least one")
                self.keep(key, item)
                self._join(item)
                return None
            old = self.reps[demoted]
            self.reps = {(key if k == demoted else k): (item if k == demoted else r) for k, r in self.reps.items()}
            self.slots = None
            near, d1, second, d2 = self.two_nearest(demoted, old.vector)
            self.keep(demoted, Item(old.vector, self.store_utility(near, d1), near, d1, second=second, second_distance=d2))
        else:
            self.reps[key] = item
            self.slots = None
        if full:
            evicted = self.worst(but=demoted)
            del self.others[evicted]  # the bins are counted anew below, after they have scored what moves
        self._renew(key, demoted)
        return evicted

    def _renew(self, added: int, removed: int | None) -> None:
        """After a change of representatives: rescore items whose nearest one changed, by the bins as they were; then representatives; then bins."""
        keys = list(self.others)
        if keys:
            to_new = distances(self.reps[added].vector, [self.others[k].vector for k in keys])
            for k, d in zip(keys, to_new, strict=True):
                item, before = self.others[k], self.others[k].utility
                if item.near is None:
                    item.near, item.distance, item.second, item.second_distance = self.two_nearest(k, item.vector)
                    item.utility = self.store_utility(item.near, item.distance)
                else:
                    if item.near == removed:
                        item.near, item.distance = item.second, item.second_distance
                        item.utility = self.store_utility(item.near, item.distance)
                        item.second, item.second_distance, _ = self.nearest(item.near, item.vector)
                    elif item.second == removed and removed is not None:
                        item.second, item.second_distance, _ = self.nearest(item.near, item.vector)
                    if d < item.distance:
                        if item.near != added:
                            item.second, item.second_distance = item.near, item.distance
                        item.near, item.distance = added, float(d)
                        item.utility = self.store_utility(added, item.distance)
                    elif added != item.near and d < item.second_distance:
                        item.second, item.second_distance = added, float(d)
                if item.utility != before:
                    self.keep(k, item)
        for k, rep in self.reps.items():
            _, d1, d2 = self.nearest(k, rep.vector)
            rep.rank = self.rep_utility(d1, d2)
        # a new representative has an empty bin; what comes nearest to it first is scored against that
        self.bins = {k: Bin() for k in self.reps if k in self.bins or k == added}
        for item in self.others.values():
            self._join(item)

    def _join(self, item: Item) -> None:
        if item.near is not None:
            b = self.bins.setdefault(item.near, Bin())
            b.load += 1
            b.total += item.distance

    def _leave(self, item: Item) -> None:
        if item.near in self.bins:
            b = self.bins[item.near]
            b.load -= 1
            b.total = max(0.0, b.total - item.distance) if b.load else 0.0


@dataclass
class ReservoirNode:
    """Algorithm R over offers."""

    capacity: int
    seed: int
    kept: list[int] = field(default_factory=list)
    held: set[int] = field(default_factory=set)
    seen: int = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)

    def holds(self, key: int) -> bool:
        return key in self.held

    def snapshot(self) -> tuple[int, float, float, int, float, float]:
        return len(self.kept), 0.0, 0.0, 0, 0.0, 0.0

    def offer(self, key: int, v: np.ndarray | None = None) -> Decision:
        self.seen += 1
        if self.capacity == 0:
            return Decision("DROPPED", "UTILITY")
        if len(self.kept) < self.capacity:
            self.kept.append(key)
            self.held.add(key)
            return Decision("ADMITTED")
        j = int(self.rng.integers(self.seen))
        if j >= self.capacity:
            return Decision("DROPPED", "UTILITY")
        out, self.kept[j] = self.kept[j], key
        self.held.remove(out)
        self.held.add(key)
        return Decision("EVICTED_AND_ADMITTED", None, out)


SNAPSHOT = "stored long, utility_sum double, least_stored double, reps long, rep_least double, rep_mean double"
EVENT = f"node int, seq long, key long, kind string, drop_cause string, evicted_key long, utility double, rep_change boolean, {SNAPSHOT}"
State = UtilityNode | ReservoirNode


def new_state(mode: str, node: int, capacity: int, max_reps: int, **balance: float) -> State:
    """An empty node; ``balance`` may hold gamma, lo and hi."""
    return ReservoirNode(capacity, 1337 + node) if mode == "random" else UtilityNode(capacity, max_reps, **balance)


def finite_or_none(x: float) -> float | None:
    return x if np.isfinite(x) else None


def decisions(node: int, state: State, rows: pd.DataFrame, seen: int = 0, every: int = 0) -> pd.DataFrame:
    """A row per offer; each ``every``-th offer of the node, counted from ``seen``, also bears the state after it."""
    out = []
    for n, (seq, key, v) in enumerate(zip(rows["seq"], rows["key"], rows["vector"], strict=True), seen + 1):
        d = state.offer(int(key), np.asarray(v, np.float32))
        told = tuple(map(finite_or_none, state.snapshot())) if every and n % every == 0 else (None,) * 6
        out.append((node, seq, key, d.kind, d.cause, d.evicted, finite_or_none(d.utility), d.rep_change, *told))
    found = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
    doubles = ("utility", "utility_sum", "least_stored", "rep_least", "rep_mean")
    return found.astype({"node": "int32", "evicted_key": "Int64", "stored": "Int64", "reps": "Int64"} | dict.fromkeys(doubles, "float64"))


def retain_in_order(items: DataFrame, mode: str, capacity: int, max_reps: int = 1, nodes: int = 36, every: int = 0, **balance: float) -> DataFrame:
    """The decision about each item (node, seq, key, vector), in the order of ``seq``.

    A node is one sorted partition, which Spark spills where it must; Python sees one Arrow batch of it at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, seen = None, None, 0
        for batch in batches:
            for node, rows in batch.groupby("node", sort=False):
                if node != at:
                    at, state, seen = node, new_state(mode, int(node), capacity, max_reps, **balance), 0
                yield decisions(int(node), state, rows, seen, every)
                seen += len(rows)

    return items.select("node", "seq", "key", "vector").repartitionById(nodes, "node").sortWithinPartitions("node", "seq", "key").mapInPandas(run, EVENT)


def stored(events: DataFrame) -> DataFrame:
    """(node, key) that remain after all decisions; a key may have been admitted again after its eviction."""
    steps = F.array(F.struct(F.when(F.col("kind").isin("ADMITTED", "EVICTED_AND_ADMITTED"), F.col("key")).alias("key"), F.lit(1).alias("n")), F.struct(F.col("evicted_key").alias("key"), F.lit(-1).alias("n")))
    moved = events.select("node", F.explode(steps).alias("x")).select("node", "x.key", "x.n").where("key IS NOT NULL")
    return moved.groupBy("node", "key").agg(F.sum("n").alias("n")).where("n > 0").select("node", "key")


def window_reports(events: DataFrame, every: int) -> DataFrame:
    """A row per node and window of ``every`` offers: counts, admit rate, mean utilities over finite values, and the state at a full window's end.

    Windows are counted over the node's own offers; ``events`` come from ``retain_in_order`` with the same ``every``.
    """
    order = Window.partitionBy("node").orderBy("seq", "key")
    numbered = events.withColumn("window_no", F.floor((F.row_number().over(order) - 1) / every))
    admitted, dropped = F.col("kind") != "DROPPED", F.col("kind") == "DROPPED"
    mean = lambda which: F.coalesce(F.avg(F.when(which, F.col("utility"))), F.lit(0.0))
    names = [c.split()[0] for c in SNAPSHOT.split(", ")]
    return numbered.groupBy("node", "window_no").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(admitted).alias("admitted"), F.count_if(dropped).alias("dropped"), F.count("evicted_key").alias("evicted"),
        F.count_if("rep_change").alias("rep_changes"), (F.count_if(admitted) / F.count(F.lit(1))).alias("admit_rate"),
        mean(F.lit(True)).alias("mean_seen"), mean(admitted).alias("mean_admitted"), mean(dropped).alias("mean_dropped"), *[F.max(c).alias(c) for c in names],
    )
