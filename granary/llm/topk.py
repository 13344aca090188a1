"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(256 * x). Rows stay where they are read: a task turns each batch of its rows into a block,
in which every term (vector component) has a postings list of the rows with a value other than 0. The queries come in
chunks of at most ``CHUNK_BYTES``; each query's weight for a term is scattered over the term's postings into a dense array of
scores. A partition selection keeps each query's ``k`` best of the block, the task merges them with those of
its blocks before, and tasks' winners are merged by rank.

Plan: no row is shuffled, copied or collected. A chunk of queries, whose size is bounded by the parameter, is broadcast, and
one pass over the rows answers it; so there are as many passes as chunks. What is shuffled are ``k`` winners for each
query and task. Results of several chunks are written to the shared folder one by one.

Scores that floats cannot hold are summed in 64-bit integers, which wrap, so every score that fits a
long is exact; pairs whose score might not fit are summed in Python integers, and the query fails if one does not.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; a component
beyond a long once scaled fails the query; missing components count as 0, so lengths may differ and an empty vector scores 0; a
very long vector is one row of a block; a row is no candidate for a query of its own id; rows that stand twice are candidates
of their own, a query that stands twice is asked once (by its smallest vector, where they differ); ties go to the smaller id;
empty tables give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

K = 5
SCALE = 256
#: Rows that one block of scores holds, and queries.
ROWS_EACH = 4096
QUERIES_EACH = 256
#: Bytes of the queries of one chunk, as integers of 8 bytes.
CHUNK_BYTES = 32 << 20


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), "embedding")


def quantised(components: np.ndarray) -> np.ndarray:
    cells = np.floor(components.astype(np.float64) * SCALE)
    if (np.abs(cells) >= 2.0**63).any():
        raise OverflowError("a component does not fit a long once scaled")
    return cells.astype(np.int64)


def block_of(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, matrix of cells, shorter vectors filled up with 0)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    own = ids.to_numpy()
    order = np.argsort(own, kind="stable")
    length = vectors.value_lengths().to_numpy().astype(np.int64)
    cells = quantised(vectors.flatten().to_numpy(zero_copy_only=False))
    dim = int(length.max(initial=0))
    matrix = np.zeros((len(own), dim), np.int64)
    matrix[np.repeat(np.arange(len(own)), length), np.arange(len(cells)) - np.repeat(np.cumsum(length) - length, length)] = cells
    return own[order], matrix[order]


def check_fit(ids: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> None:
    """Fail if a candidate's score does not fit a long; only pairs that floats leave in doubt are summed exactly."""
    dim = min(cells.shape[1], queries.shape[1])
    a, b = cells[:, :dim].astype(np.float64), queries[:, :dim].astype(np.float64)
    doubt = np.abs(a @ b.T) + (np.abs(a) @ np.abs(b).T) * (dim + 4) * 2.0**-52 >= 2.0**63
    for r, q in np.argwhere(doubt & (ids[:, None] != query_ids[None, :])):
        if not -(1 << 63) <= sum(x * y for x, y in zip(cells[r, :dim].tolist(), queries[q, :dim].tolist(), strict=True)) < 1 << 63:
            raise OverflowError(f"the score of {ids[r]} for {query_ids[q]} does not fit a long")


def best(ids: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` best rows, by term-at-a-time accumulation."""
    top = int(np.abs(cells, dtype=np.int64).max(initial=0)) * int(np.abs(queries, dtype=np.int64).max(initial=0)) * max(1, cells.shape[1])
    kind = np.float64 if top < 1 << 52 else np.int64  # whole numbers, exact either way
    if top >= 1 << 63:
        check_fit(ids, cells, query_ids, queries)
    scores = np.zeros((len(ids), len(query_ids)), kind)
    for term in range(min(cells.shape[1], queries.shape[1])):
        weights = queries[:, term].astype(kind)
        asking = np.flatnonzero(weights)
        postings = np.flatnonzero(cells[:, term])
        if not len(asking) or not len(postings):
            continue
        values = cells[postings, term].astype(kind)
        if len(postings) > 0.9 * len(ids):  # nearly all rows: add zeros rather than gather
            scores += np.multiply.outer(cells[:, term].astype(kind), weights)
        else:
            scores[postings] += np.multiply.outer(values, weights)
    # ids ascend, so the place breaks ties; the order is by score, then by place
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = np.arange(len(ids))
    whole = scores.astype(np.int64)
    for q, own in enumerate(query_ids):
        allowed = place[ids != own]
        s = whole[allowed, q]
        if len(allowed) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            chosen = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
        else:
            chosen = np.arange(len(allowed))
        out.append((np.full(len(chosen), own), ids[allowed[chosen]], s[chosen]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def merged(kept: tuple[np.ndarray, ...] | None, found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query among both, by score, then by id."""
    q, v, s = (np.concatenate(x) for x in zip(kept, found, strict=True)) if kept else found
    order = np.lexsort((v, -s.astype(np.float64), q)) if len(s) == 0 or np.abs(s).max() < 1 << 53 else np.array(sorted(range(len(s)), key=lambda i: (q[i], -int(s[i]), v[i])))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], v[rank < k], s[rank < k]


def answered(rows: DataFrame, asked: list, k: int, rows_each: int, queries_each: int) -> DataFrame:
    """(query_id, vec_id, score): each task's ``k`` best of its rows for the queries ``asked``, at most a chunk."""
    queries = rows.sparkSession.sparkContext.broadcast(block_of(pa.array([r.vec_id for r in asked], pa.int64()), pa.array([list(r.embedding) for r in asked], pa.list_(pa.float64()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, asking = queries.value
        kept: list = [None] * -(-len(q_ids) // queries_each)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_each):
                part = batch.slice(at, rows_each)
                ids, cells = block_of(part.column(0), part.column(1))
                for n, a in enumerate(range(0, len(q_ids), queries_each)):
                    kept[n] = merged(kept[n], best(ids, cells, q_ids[a : a + queries_each], asking[a : a + queries_each], k), k)
        for found in kept:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, rows_each: int = ROWS_EACH, queries_each: int = QUERIES_EACH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each vector of ``queries``: query_id, rank, vec_id, score."""
    rows = sound(vectors)
    asked = sound(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    chunks = max(1, -(-(n * (dim or 1) * 8) // chunk_bytes))
    of_chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks))
    if chunks > 1:
        asked = written(asked.withColumn("chunk", of_chunk).repartition(chunks, "chunk").sortWithinPartitions("chunk"), "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = None
    for c in range(chunks):
        own = (asked.where(F.col("chunk") == c) if chunks > 1 else asked).select("vec_id", "embedding").collect()  # at most a chunk
        partial = answered(rows, own, k, rows_each, queries_each)
        found = partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = written(found, "winners") if chunks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for each whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
t AS (SELECT vec_id, unnest(c) AS x, unnest(range(len(c))) AS i FROM v),
p AS (
  SELECT q.vec_id AS query_id, t.vec_id, CAST(sum(q.x * t.x) AS BIGINT) AS score
  FROM t q JOIN t ON q.i = t.i AND q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= {K}
"""
