"""Near duplicates by HyperMinHash banding, verified on whole shingle sets.

Texts (A-Z lower-cased) become sets of ``words_each``-word shingles, as 64-bit hashes.
A sketch has 128 buckets; a bucket keeps, of its smallest hash, the leading-zero count and
ten mantissa bits: one 16-bit register. Four registers are a band, 32 bands a document, so a
link at the threshold escapes all bands with a probability under 1e-7.

1. Documents with the same word sequence form a class; the smallest id stands for it.
2. In each bucket of equal bands, all members are candidates of the smallest one. The
   registers' Jaccard estimate, corrected for chance collisions, drops candidates that are
   more than six standard deviations below the threshold; the others are verified on their
   whole sets, streamed past the smallest member's set. The links' components come next.
3. Members of a bucket that are not yet in one component - other than its smallest, whose
   pairs are done - go through two sieves. Those outside the bucket's largest component are the others; only pairs with one of
   them are open. First the registers are estimated, blocks of others against all blocks, and members without any promising
   partner leave. Then, in a bucket with more than ``BLOCK`` others left, a document leaves
   whose shingles that other components hold, too, are too few for any link (``linkable``); this is exact, and no text of the
   pages of one template, all about as far from each other, is compared.
4. Only the texts of what is left are compared with each other in blocks of bounded size: a block pair counts common
   shingles by matrix products and returns only links that join two components.
So every pair that shares a band is estimated and verified, ruled out exactly or already connected, no pairs are listed, and
a group of copies costs its size, also if up to ``BLOCK`` of its bucket are not connected to it. Members that are not connected cost
their number squared in comparisons of 256 bytes, and only those near each other that pass the sieves in comparisons of sets, in blocks of ``BLOCK``.

Plan: texts are shuffled once per stage of verification, and only rows of candidates go on. What a later plan reads more than
once is written first, so that no plan holds another one several times: the driver keeps a thread for each of a plan's exchanges and
writes the whole plan down each time one is done.
Groups of a common smallest member are salted by their size; classes, and shingles that very many documents hold, are
met as ``common.joined_evenly`` tells.

Defined cases: null and empty texts have an empty set and link with nothing; texts of fewer words
than a shingle are one shingle; a very long text is one set, held whole while it is compared; rows that stand twice are in one class;
rows with one id but different texts are one node; a null id links with nothing and is kept; of equal texts the smallest id
stands; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, files_for, joined_evenly, loads_of, mix64, sequence_hashes, slices, window_hashes, written
from .components import components

U = np.uint64
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
EMPTY = 0xFFFF
ROWS_IN_BAND = 4
BLOCK = 1024
#: Members whose registers one block holds.
REGISTER_BLOCK = 8192
#: Shingles of the whole sets in a block, about.
BLOCK_SHINGLES = 4 << 20
#: Members of a common smallest one that one task streams past it.
SALT_EACH = 512
COLUMNS = 4096
#: The constant of HyperMinHash's approximation of expected collisions.
COLLISION = 0.169919487159739
DEVIATIONS = 6


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, count = words.hashes(lower=True), words.count()
    h, row, _ = window_hashes(hashes, words.first, k)
    sets = [np.zeros(0, U)] * words.n_rows
    cut = np.searchsorted(row, np.arange(words.n_rows + 1))
    for i in np.flatnonzero(count >= k):
        sets[i] = np.unique(h[cut[i] : cut[i + 1]])
    for i in np.flatnonzero((count > 0) & (count < k)):
        n = int(count[i])
        own = window_hashes(hashes[words.first[i] : words.first[i] + n], np.array([0, n]), n)[0]
        sets[i] = mix64(own + U(n))
    return sets


def registers(shingle_set: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a sorted set: leading zeros above the mantissa's bits."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(shingle_set):
        bucket = (shingle_set >> U(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = (shingle_set[first] << U(BUCKET_BITS)) >> U(12)  # 52 bits, exact as a float
        power = np.frexp(rest.astype(np.float64))[1]  # bits in use, 0 for 0
        zeros = 52 - power
        lead = np.where(power > MANTISSA, rest >> np.maximum(power - 1 - MANTISSA, 0).astype(U), rest << np.maximum(MANTISSA + 1 - power, 0).astype(U))
        out[bucket[first]] = (zeros.astype(np.uint16) << MANTISSA) | (lead.astype(np.int64) & ((1 << MANTISSA) - 1)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard, registers in use) of register matrices whose sets have n and m shingles."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    alike = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = n / m
    chance = COLLISION * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(alike - chance, 0) / np.maximum(used, 1), used


SKETCH = "doc_id long, one long, two long, n_shingles long, registers binary"


def sketches(docs: DataFrame, words_each: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                one, two = sequence_hashes(words, lower=True)
                sets = shingles(words, words_each)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(one), pa.array(two), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "one", "two", "n_shingles", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def bands(reps: DataFrame) -> DataFrame:
    """(key, doc_id): the bands of each representative; bands without any shingle are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), U).reshape(len(ids), -1) if len(ids) else np.zeros((0, BUCKETS // ROWS_IN_BAND), U)
            full = keys != U(0xFFFFFFFFFFFFFFFF)
            mixed = mix64(keys ^ mix64(np.arange(1, keys.shape[1] + 1, dtype=U))[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(mixed[full].view(np.int64)), pa.array(np.broadcast_to(ids[:, None], keys.shape)[full])], names=["key", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def promising(pairs: DataFrame, reps: DataFrame, percent: int, files: int) -> DataFrame:
    """The (lead, doc_id) pairs whose sizes and registers allow a link."""
    loads = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("rows"))
    other = written(reps.select(F.col("doc_id").alias("lead"), F.col("n_shingles").alias("m"), F.col("registers").alias("lead_registers")).join(loads, "lead"), "leads", files)
    total, most = loads_of(other, "rows")
    sized = joined_evenly(pairs.join(reps.select("doc_id", F.col("n_shingles").alias("n"), "registers"), "doc_id"), other, ["lead"], "rows", total, F.col("doc_id"), most=most)
    sized = sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("lead", "doc_id", "n", "m", "registers", "lead_registers")
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy().astype(np.float64) for k in ("n", "m"))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS) for k in ("registers", "lead_registers"))
            found, used = estimate(a, b, n, m)
            near = found >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(used, 1))
            yield batch.select(["lead", "doc_id"]).filter(pa.array(near))

    return sized.mapInArrow(run, "lead long, doc_id long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def verified(pairs: DataFrame, texts: DataFrame, words_each: int, percent: int, files: int) -> DataFrame:
    """(x, y): the (lead, doc_id) pairs that are links by their whole sets."""
    size = written(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("rows")).withColumn("salts", F.ceil(F.col("rows") / SALT_EACH)), "salts", files)
    total, most = loads_of(size, "rows")
    salted = joined_evenly(pairs, size, ["lead"], "rows", total, F.col("doc_id"), most=most).select("lead", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), F.col("doc_id").alias("node"))
    leads = size.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("lead").alias("node"))
    need = salted.unionByName(leads)
    rows = need.join(texts.withColumnRenamed("doc_id", "node"), "node")
    dealt = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind", "node").select("lead", "kind", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sets = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                x, y = [], []
                found = shingles(Words(part.column("text")), words_each)
                for lead, kind, node, s in zip(part.column("lead").to_pylist(), part.column("kind").to_pylist(), part.column("node").to_pylist(), found, strict=True):
                    if kind == 0:
                        if lead != own:
                            own, sets = lead, []
                        sets.append(s)
                        continue
                    for t in sets if lead == own else ():
                        n = common(s, t)
                        if n and 100 * n >= percent * (len(s) + len(t) - n):
                            x.append(lead)
                            y.append(node)
                            break
                if x:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return dealt.mapInArrow(run, "x long, y long")


def links_in_block(sets: list[np.ndarray], groups: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (``side`` 0 and 1; all against all if one side is empty) that join different groups.

    Common shingles are counted by products of incidence matrices, over shingles that two sets share.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    left, right = (np.flatnonzero(side == k) for k in (0, 1))
    if not len(left) or not len(right):
        left = right = np.arange(len(sets))
    counts = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, n_columns, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        held_in = np.zeros((len(sets), min(COLUMNS, n_columns - a)), np.float32)
        held_in[owner[lo:hi], column[lo:hi] - a] = 1
        counts += held_in[left] @ held_in[right].T
    union = size[left][:, None] + size[right][None, :] - counts
    good = (100 * counts >= percent * union) & (counts > 0) & (groups[left][:, None] != groups[right][None, :])
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while v in root:
            v = root[v]
        return v

    out = []
    for i, j in np.argwhere(good):
        a, b = top(int(groups[left[i]])), top(int(groups[right[j]]))
        if a != b:
            root[a] = b
            out.append((int(left[i]), int(right[j])))
    return out


def mixed_keys(members: DataFrame, files: int) -> DataFrame:
    """The members (key, doc_id, component) of keys whose members are in two components or more, equal groups of members once.

    ``main`` tells whether the row's component is the key's largest, ``mains`` and ``others`` how many rows of the key are and are not of it.
    """
    of_component = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("same"))
    of_key = of_component.groupBy("key").agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("rows"), F.max("n").alias("mains"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("same").alias("same")
    )
    mixed = of_key.where("components > 1")
    once = mixed.groupBy("rows", "same", "mains", "largest").agg(F.min("key").alias("key")).select("key", "rows", "mains", (F.col("rows") - F.col("mains")).alias("others"), "largest")
    once = written(once.withColumn("count", F.col("rows")), "mixed", files)
    total, most = loads_of(once, "count")
    met = joined_evenly(members, once.drop("rows"), ["key"], "count", total, F.col("doc_id"), most=most)
    return met.select("key", "doc_id", "component", (F.col("component") == F.col("largest")).alias("main"), "mains", "others")


def dealt(members: DataFrame, main_blocks: Column, other_blocks: Column) -> DataFrame:
    """(key, i, j, side, doc_id, component): every member in each pair of blocks that holds its own, but for pairs of main blocks, which are connected.

    Blocks of the other members are numbered first. ``side`` tells which block of a pair a member is of.
    """
    own = members.withColumns({"bo": other_blocks, "bm": main_blocks}).withColumn("block", F.when(F.col("main"), F.col("bo") + F.pmod(F.xxhash64("doc_id"), F.col("bm"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("bo"))))
    last = F.when(F.col("main"), F.col("bo")).otherwise(F.col("bo") + F.col("bm")) - 1
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda t: F.struct(F.greatest(t, F.col("block")).alias("i"), F.least(t, F.col("block")).alias("j"))))
    units = own.select("key", "doc_id", "component", "block", pair.alias("p"))
    return units.select("key", "p.i", "p.j", (F.col("block") != F.col("p.j")).cast("int").alias("side"), "doc_id", "component")


def blocks_of(rows: str, each: int) -> Column:
    return F.ceil(F.col(rows) / each)


def linkable(members: DataFrame, texts: DataFrame, words_each: int, percent: int, files: int) -> DataFrame:
    """``members`` without those that too few shingles of other components allow a link.

    A link of sets of n and m shingles with o in common has o >= t * n. The shingles of a document that another component holds
    are s at most; and if no member of the key shares more than a part r of its own, m >= o / r, so that the
    similarity is at most s / (n - s + s / r).
    """
    nodes = members.groupBy("doc_id").agg(F.min("component").alias("component"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                sets = shingles(words, words_each)
                sign, size = sequence_hashes(words, lower=True)[0], np.array([len(s) for s in sets], np.int64)
                row = np.repeat(np.arange(len(sets)), size)
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.view(np.int64)), part.column("doc_id").take(at), part.column("component").take(at), pa.array(sign[row]), pa.array(size[row])], names=["h", "doc_id", "component", "sign", "n"]
                )

    held = texts.join(nodes, "doc_id").select("doc_id", "component", "text").mapInArrow(run, "h long, doc_id long, component long, sign long, n long")
    common_to = held.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("rows")).where("a <> b").select("h", "rows")
    common_to = written(common_to, "common", files)
    total, most = loads_of(common_to, "rows")
    met = joined_evenly(held, common_to, ["h"], "rows", total, F.col("doc_id"), most=most)
    able = met.groupBy("doc_id", "sign", "n").agg(F.count(F.lit(1)).alias("s")).where(100 * F.col("s") >= percent * F.col("n"))
    able = written(able.select("doc_id", "n", "s", (F.col("s") / F.col("n")).alias("part")), "able", files)
    parts = members.join(able, "doc_id")
    most = parts.groupBy("key").agg(F.max("part").alias("r"), F.count(F.lit(1)).alias("rows"))
    bounded = joined_evenly(parts, most, ["key"], "rows", parts.count(), F.col("doc_id"))
    near = F.col("s") * 100 >= percent * (F.col("n") - F.col("s") + F.col("s") / F.col("r")) * (1 - 1e-9)
    return bounded.where(near).select("key", "doc_id", "component").distinct()


def near_in_block(registers: np.ndarray, sizes: np.ndarray, groups: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a promising partner of another group: on the other side, or anywhere if one side is empty."""
    left, right = (np.flatnonzero(side == k) for k in (0, 1))
    if not len(left) or not len(right):
        left = right = np.arange(len(sizes))
    out = np.zeros(len(sizes), bool)
    least = percent / 100
    other = registers[right]
    columns = np.ascontiguousarray(other.T)
    in_other = (other != EMPTY).astype(np.float32)
    for a in range(0, len(left), 64):
        rows = left[a : a + 64]
        own = registers[rows]
        both = (own != EMPTY).astype(np.float32) @ in_other.T
        mine = np.where(own == EMPTY, np.uint16(EMPTY - 1), own)  # equal to none
        alike, equal = np.zeros((len(rows), len(right)), np.uint8), np.empty((len(rows), len(right)), bool)
        for r in range(BUCKETS):
            np.equal(mine[:, r, None], columns[r][None, :], out=equal)
            alike += equal.view(np.uint8)
        used = (own != EMPTY).sum(axis=1)[:, None] + (other != EMPTY).sum(axis=1)[None, :] - both
        n, m = sizes[rows][:, None].astype(np.float64), sizes[right][None, :].astype(np.float64)
        ratio = n / m
        chance = COLLISION * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
        found = np.maximum(alike - chance, 0) / np.maximum(used, 1)
        near = (found >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(used, 1))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (groups[rows][:, None] != groups[right][None, :])
        out[rows] |= near.any(axis=1)
        out[right] |= near.any(axis=0)
    return out


def promising_members(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The members that have a partner of another component in their key which registers and sizes allow, by blocks of registers alone."""
    units = dealt(members, blocks_of("mains", REGISTER_BLOCK), blocks_of("others", REGISTER_BLOCK)).join(reps.select("doc_id", "n_shingles", "registers"), "doc_id")
    rows = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "side", "doc_id", "component", "n_shingles", "registers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            unit = pa.Table.from_batches(held)
            side, ids, groups, sizes = (unit.column(k).to_numpy() for k in ("side", "doc_id", "component", "n_shingles"))
            registers = np.frombuffer(b"".join(unit.column("registers").to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
            near = near_in_block(registers, sizes, groups, side, percent)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(near.sum()), at[0])), pa.array(ids[near]), pa.array(groups[near])], names=["key", "doc_id", "component"])

        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in ("key", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                unit = tuple(int(k[a]) for k in keys)
                if unit != at and held:
                    yield from done()
                    held = []
                at = unit
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return rows.mapInArrow(run, "key long, doc_id long, component long").distinct()


def cross_links(members: DataFrame, reps: DataFrame, texts: DataFrame, words_each: int, percent: int, files: int) -> DataFrame:
    """(x, y): links between members (key, doc_id, component) of one key in different components, by their whole sets."""
    sets = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    sized = members.join(sets, "doc_id")
    of_main = lambda main: F.sum(F.when(F.col("main") == F.lit(main), F.col("n")).otherwise(0))
    loads = sized.groupBy("key").agg(of_main(True).alias("main_shingles"), of_main(False).alias("other_shingles"), F.count(F.lit(1)).alias("rows"))
    loads = written(loads, "loads", files)
    total, most = loads_of(loads, "rows")
    held = joined_evenly(members, loads, ["key"], "rows", total, F.col("doc_id"), most=most)
    by_size = lambda rows, n: F.greatest(blocks_of(rows, BLOCK), F.ceil(F.col(n) / BLOCK_SHINGLES))
    units = dealt(held, by_size("mains", "main_shingles"), by_size("others", "other_shingles"))
    rows = units.join(texts, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id").select("key", "i", "j", "doc_id", "component", "side", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, groups, sides = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(set(groups)) > 1:
                found = links_in_block(sets, np.array(groups), np.array(sides), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["x", "y"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = shingles(Words(part.column("text")), words_each)
                unit = list(zip(*(part.column(k).to_pylist() for k in ("key", "i", "j")), strict=True))
                for u, doc, group, side, s in zip(unit, part.column("doc_id").to_pylist(), part.column("component").to_pylist(), part.column("side").to_pylist(), found, strict=True):
                    if u != at:
                        yield from done()
                        at, ids, sets, groups, sides = u, [], [], [], []
                    ids.append(doc)
                    sets.append(s)
                    groups.append(group)
                    sides.append(side)
        yield from done()

    return rows.mapInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept (whether it is its component's smallest)."""
    files = files_for(docs.select("doc_id", "text"))
    sketched = written(sketches(docs, words_each), "sketches", files)
    linked = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(linked.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes", files)
    firsts = classes.select(F.col("rep").alias("doc_id"), "one", "two")
    reps = written(linked.join(firsts, ["doc_id", "one", "two"], "left_semi").dropDuplicates(["doc_id", "one", "two"]), "reps", files)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    banded = bands(reps)
    leads = banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows")).where("lead <> last").select("key", "lead", "rows")
    leads = written(leads, "leads", files)
    total, most = loads_of(leads, "rows")
    met = joined_evenly(banded, leads, ["key"], "rows", total, F.col("doc_id"), most=most)
    members = written(met.where("doc_id <> lead").distinct(), "members", files)
    candidates = written(members.select("lead", "doc_id").distinct(), "candidates", files)
    pairs = written(promising(candidates, reps, percent, files), "pairs", files)
    first = written(verified(pairs, own, words_each, percent, files), "links", files)
    final = groups = written(components(first, files), "groups", files)
    named = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    apart = written(mixed_keys(named, files), "apart", files)
    near = written(mixed_keys(written(promising_members(apart, reps, percent), "promising", files), files), "near", files)
    large = near.where(F.col("others") > BLOCK).select("key", "doc_id", "component")
    if not large.isEmpty():
        sieved = written(linkable(large, own, words_each, percent, files), "linkable", files)
        near = near.where(F.col("others") <= BLOCK).unionByName(mixed_keys(sieved, files))
    second = written(cross_links(near, reps, own, words_each, percent, files), "links", files)
    if not second.isEmpty():
        final = written(components(first.unionByName(second), files), "components", files)
    of_class = classes.join(final, classes["rep"] == final["node"], "left").select("one", "two", F.coalesce("component", "rep").alias("component"), "rows")
    of_doc = final.select(F.col("node").alias("doc_id"), F.col("component").alias("own_component"))
    listed = sketched.select("doc_id", "one", "two", "n_shingles")
    total, most = loads_of(classes, "rows")
    rows = joined_evenly(listed, of_class, ["one", "two"], "rows", total, F.col("doc_id"), keep="left", most=most).join(of_doc, "doc_id", "left")
    # a copy's component is its class's; an id that has links under another text stays with those
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.least(F.coalesce("component", "doc_id"), F.coalesce("own_component", "component", "doc_id")))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: 3-word shingles, links at a Jaccard similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


#: An exact join: texts that are similar enough share one of their rarest shingles; then components by recursion.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
cut AS (SELECT doc_id, words, CAST(unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS INTEGER) AS i FROM w WHERE len(words) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(words[i:i + 2], ' ')) AS h FROM cut),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS MATERIALIZED (SELECT doc_id, n, md5(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h)) AS class FROM s JOIN sizes USING (doc_id) GROUP BY ALL),
reps AS MATERIALIZED (SELECT class, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY class),
places AS MATERIALIZED (SELECT rep, n, h, row_number() OVER (PARTITION BY rep ORDER BY f, h) AS place FROM (SELECT doc_id AS rep, h, count(*) OVER (PARTITION BY h) AS f FROM s WHERE doc_id IN (SELECT rep FROM reps)) JOIN reps USING (rep)),
prefix AS MATERIALIZED (SELECT * FROM places WHERE place <= n - (85 * n + 99) // 100 + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.h = b.h AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN places x ON x.rep = a JOIN places y ON y.rep = b AND y.h = x.h GROUP BY a, b, na, nb HAVING 100 * count(*) >= 85 * (na + nb - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT b AS rep, min(a) AS component FROM reach GROUP BY b)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN reps USING (class) LEFT JOIN comp ON comp.rep = reps.rep
"""
