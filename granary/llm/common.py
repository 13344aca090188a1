"""What the training-data operators share: shared storage, Arrow words, hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. All separators are single bytes
below 0x80, so words are found on UTF-8 bytes without decoding.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Bytes of text that one vectorised step handles.
SEGMENT = 1 << 20
#: Bytes that a plan reads for each file of a table that is derived from it.
FILE_BYTES = 16 << 20
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a new one; a cluster fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="granary-")
        else:
            raise ValueError("spark.checkpoint.dir is not set: a cluster must name a folder that its executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def files_for(docs: DataFrame) -> int:
    """How many files a table derived from ``docs`` is written to at most: one for each ``FILE_BYTES`` that the plan reads."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(16, min(1 << 20, size // FILE_BYTES))


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, in ``files`` files at most, and read again: lineage ends, lost executors don't matter."""
    path = shared_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets an operator's own."""
    return F.struct(*[quoted(c).alias(c) for c in docs.columns])


def unpacked(row: Column, names: list[str]) -> list[Column]:
    """The columns of a struct that ``whole`` made."""
    return [row.getField(c).alias(c) for c in names]


#: Keys with more than this share of all rows, and more than so many rows, are hot: fewer than ``HOT_KEYS`` can be.
HOT_KEYS = 1024
HOT_ROWS = 512


def loads_of(keyed: DataFrame, count: str) -> tuple[int, int]:
    """The sum and the largest of ``count``: ``total`` and ``most`` of ``joined_evenly``."""
    total, most = keyed.agg(F.sum(count), F.max(count)).first()
    return total or 0, most or 0


def joined_evenly(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, spread: Column, keep: str = "inner", most: int | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per key and, in ``count``, how many of the ``total`` rows bear it.

    Hot keys - fewer than ``HOT_KEYS``, as each has over a ``HOT_KEYS``th of all rows - are broadcast, and their rows
    are dealt by ``spread`` instead of by the key, so no task gets all rows of one. ``count`` is dropped. If ``most``, the largest
    count, tells that no key is hot, the plan is a plain join.
    """
    values = [c for c in keyed.columns if c not in on and c != count]
    limit = max(HOT_ROWS, total // HOT_KEYS)
    pack = lambda name: F.struct(F.lit(True).alias("met"), *values).alias(name)
    if most is not None and most <= limit:
        met = rows.join(keyed.select(*on, pack("__cold")), on, keep)
        return met.select(*rows.columns, *[F.col("__cold").getField(v).alias(v) for v in values])
    hot = F.broadcast(keyed.where(F.col(count) > limit).select(*on, pack("__hot")))
    cold = keyed.where(F.col(count) <= limit).select(*on, F.lit(0).cast("long").alias("__salt"), pack("__cold"))
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(HOT_KEYS))).cast("long")
    met = rows.join(hot, on, "left").withColumn("__salt", salt).join(cold, [*on, "__salt"], "left")
    found = F.coalesce("__hot", "__cold")
    out = met if keep == "left" else met.where(found.isNotNull())
    return out.select(*rows.columns, *[found.getField(v).alias(v) for v in values])


def sized_partitions(n_rows: int, rows_each: int, least: int = 1) -> int:
    """How many partitions or groups hold ``n_rows`` at ``rows_each``."""
    return max(least, -(-n_rows // rows_each))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit value for each byte, by rule: splitmix64 of the byte's place.
BYTE_VALUE = mix64((np.arange(1, 257, dtype=U)) * U(0x9E3779B97F4A7C15))
#: The same with A-Z taken as a-z.
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]
_BASE = U(0x9DDFEA08EB382D69)
_INVERSE = U(pow(0x9DDFEA08EB382D69, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SEGMENT + 1
    while size < n:
        size *= 2
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def released() -> None:
    """Gives back to the system what this process holds of memory that nothing uses any more."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Words:
    """The words of a column of texts.

    ``start``/``end`` are byte places in ``data``; row ``i`` has the words
    ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[offs[0] : offs[-1]]
        self.offsets = offs - offs[0]
        self.n_rows = n
        self._find()

    def _find(self) -> None:
        d, offs = self.data, self.offsets
        self.is_word = word = (d != 32) & ((d < 9) | (d > 13))
        if len(d):
            before = np.empty(len(d), bool)
            before[0], before[1:] = False, word[:-1]
            edge = offs[:-1][offs[:-1] < len(d)]
            before[edge] = False
            self.start = np.flatnonzero(word & ~before)
            after = np.empty(len(d), bool)
            after[-1], after[:-1] = False, word[1:]
            edge = offs[1:][offs[1:] > 0] - 1
            after[edge] = False
            self.end = np.flatnonzero(word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offs)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def _segments(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that span about ``SEGMENT`` bytes."""
        a, n = 0, len(self.start)
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + SEGMENT, "right")))
            yield a, b
            a = b

    def hashes(self, lower: bool = False, lead: tuple[int, ...] = ()) -> np.ndarray | tuple[np.ndarray, ...]:
        """A 64-bit hash of each word; with ``lead``, also of its first so many bytes."""
        values = BYTE_VALUE_LOWER if lower else BYTE_VALUE
        out = [np.empty(len(self.start), U) for _ in range(1 + len(lead))]
        for a, b in self._segments():
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            up, down = _pow(hi - lo)
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(values[self.data[lo:hi]] * up[: hi - lo], out=sums[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            out[0][a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
            for o, k in zip(out[1:], lead, strict=True):
                cut = np.minimum(e, s + k)
                o[a:b] = mix64((sums[cut] - sums[s]) * down[s] + U(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        return tuple(out) if lead else out[0]

    def text(self, a: int, b: int) -> list[bytes]:
        """The words ``a:b`` as bytes."""
        raw = self.data
        return [raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.n_rows), self.count())


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words inside one row: (hash, row, place of the first word)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for j in range(k):
        h *= _BASE
        h += words[j : j + n]
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    place = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix64(h[place]), row[place], place


def sequence_hashes(words: Words, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence."""
    h, count = words.hashes(lower=lower), words.count()
    up = _pow(int(count.max(initial=0)) + 1)[0]
    local = np.arange(len(h)) - np.repeat(words.first[:-1], count)
    out = []
    for v in (h, mix64(h ^ U(0x5851F42D4C957F2D))):
        sums = np.zeros(words.n_rows, U)
        full = np.flatnonzero(count)
        if len(full):
            sums[full] = np.add.reduceat(v * up[local], words.first[:-1][full])
        out.append(mix64(sums + count.astype(U)).view(np.int64))
    return out[0], out[1]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in ``column`` hold about ``most`` bytes; one long text stays whole."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, a = np.cumsum(size), 0
    while a < len(total):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(a, b - a)
        a = b
