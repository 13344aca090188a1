"""Cost-balanced packing of token pieces into sequences.

A sequence costs ``LINEAR * tokens + QUADRATIC * tokens ** 2`` for each piece in it
(attention stays inside a piece). Documents become ids plus one end id; full sequences
are cut off first, and the rests, in descending order, go to the sequence of lowest cost
that can hold them, among all; only where none can, the rest is cut to fill the cheapest
one with free tokens. The number of sequences is the least that holds all
tokens, so a chunk pads less than one sequence.

Plan: nothing is shuffled. A task encodes its texts where it reads them, sends out full sequences at once and packs the
rests of each ``CHUNK_DOCS`` documents by themselves, so it holds under ``CHUNK_DOCS * LENGTH`` ids however long the texts
are, no key can be hot, and each task pads less than a sequence per chunk. The partition's number and a running
number make a sequence_id; a table read in other partitions packs otherwise.

Defined cases: null and empty texts are the end id alone; a very long text is many full sequences and a rest; a null doc_id
is packed as any other; rows that stand twice are packed twice, as are their pieces; pieces of equal length go in the order
of their rows, and sequences of equal cost in that of their numbers; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import slices

LENGTH = 1024
END_ID = 0
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
CHUNK_DOCS = 4096


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, first token in it, tokens) for pieces of under ``length`` tokens each.

    Pieces go in descending order of cost to the sequence of lowest cost with room.
    """
    total = sum(lengths)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-total // length))]
    free, paid = [length] * len(sequences), [0.0] * len(sequences)
    # pieces only get shorter, so a sequence with room keeps it until it takes a piece
    room = [(0.0, b) for b in range(len(sequences))]  # a heap as it is
    waiting = [False] * len(sequences)
    by_free: list[tuple[int, int]] = []
    by_cost: list[tuple[float, int]] = []  # entries outlive the wait, here and above
    rest = [(-n, p, 0) for p, n in enumerate(lengths) if n]
    heapq.heapify(rest)
    while rest:
        n, piece, at = heapq.heappop(rest)
        n = -n
        while by_free and -by_free[0][0] >= n:
            b = heapq.heappop(by_free)[1]
            if waiting[b]:
                waiting[b] = False
                heapq.heappush(room, (paid[b], b))
        if room:
            b = heapq.heappop(room)[1]
        else:
            while not waiting[by_cost[0][1]] or paid[by_cost[0][1]] != by_cost[0][0]:
                heapq.heappop(by_cost)
            b = heapq.heappop(by_cost)[1]  # the cut fills it
        fits = min(n, free[b])
        sequences[b].append((piece, at, fits))
        free[b] -= fits
        paid[b] += cost(fits)
        waiting[b] = free[b] > 0
        if waiting[b]:
            heapq.heappush(by_free, (-free[b], b))
            heapq.heappush(by_cost, (paid[b], b))
        if fits < n:
            heapq.heappush(rest, (fits - n, piece, at + fits))
    return sequences


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, ranks: str | None = None, keep_ids: bool = True, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """One row per piece; with ``keep_ids`` also its ids as little-endian 32-bit numbers."""
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")] + [("ids", pa.binary())] * keep_ids)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def piece(doc: int | None, at: int, ids: np.ndarray, whole: int, sequence: int, offset: int) -> tuple:
        raw = ids.tobytes()
        return (doc, at, len(ids), zlib.crc32(raw), whole, sequence, offset, *([raw] * keep_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rests: list[tuple[int | None, int, np.ndarray, int]] = []
        number = 0

        def packed(first: int) -> Iterator[pa.RecordBatch]:
            rows = []
            for s, pieces in enumerate(assign([len(r[2]) for r in rests], length)):
                offset = 0
                for p, at, n in pieces:
                    doc, head, ids, whole = rests[p]
                    rows.append(piece(doc, head + at, ids[at : at + n], whole, first + s, offset))
                    offset += n
            for a in range(0, len(rows), 1024):
                yield table(rows[a : a + 1024])

        for batch in batches:
            rows = []
            for doc, text, part in (r for cut in slices(batch, "text") for r in zip(*(cut.column(k).to_pylist() for k in range(3)), strict=True)):
                number = number or part << 32
                ids = np.append(tokens.ids(text or "", ranks), END_ID).astype("<u4")
                head = len(ids) // length * length
                for at in range(0, head, length):
                    rows.append(piece(doc, at, ids[at : at + length], len(ids), number, 0))
                    number += 1
                if head < len(ids):
                    rests.append((doc, head, ids[head:].copy(), len(ids)))
                if len(rows) >= 256:
                    yield table(rows)
                    rows = []
                if len(rests) >= chunk_docs:
                    yield from packed(number)
                    number += -(-sum(len(r[2]) for r in rests) // length)
                    rests = []
            if rows:
                yield table(rows)
        if rests:
            yield from packed(number)

    placed = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().cast("long"))
    return placed.mapInArrow(run, PIECE + ", ids binary" * keep_ids)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)


SQL = None
