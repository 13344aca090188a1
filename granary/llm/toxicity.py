"""Toxicity by a convolutional text classifier, trained here in numpy.

A word (lower case, outer punctuation off) has three hashed embeddings - of the word
and of its first 4 and 5 bytes, so that inflected forms share - which are summed.
Filters of widths 1, 2 and 3 run over all words of the text, each filter keeps its
maximum, and a logistic unit gives the score. Embeddings that training never
moved are set to 0, so unknown words are neutral. Thresholds are calibrated per language on all labelled
rows that are neither trained on nor held out; the score itself sees the text alone.

The weights are learnt from a bounded sample: the ``PER_CLASS`` rows of each label with
the smallest hash among texts of at most ``MOST_CHARS`` characters, without those left for
calibration (a fifth of each language and class, and up to ``LEAST_ROWS`` of small ones). Scoring covers every
word of every text. The model is of fixed size (12.6 MB) and is broadcast.

Plan of the calibration: all texts are scored where they are read, only ids and scores meet the
labels, and the driver gets the counts of each language's bins of scores.

Defined cases: null and empty texts are scored as texts without words; very long texts are scored whole; a score equal to a threshold is
toxic, and equal scores are on one side of any; a null language has the global threshold; rows that stand twice
are scored twice; labels that are null or whose document is null teach nothing, and of several
labels of one document the largest counts; with labels of one class only, or none, every score
is 0; a null doc_id is not held out; an empty table gives no rows; further columns are kept by
``scored`` unless they bear its own columns' names, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, released, slices, unpacked, whole

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
LEAD = (4, 5)
PAD = max(WIDTHS)
PER_CLASS = 2500
MOST_CHARS = 20_000
#: Characters of the sample that the driver takes words of at a time.
SAMPLE_CHARS = 1 << 18
EPOCHS = 6
LEAST_STEPS = 600
BATCH = 32
RATE = 0.005
SEED = 20
#: How much a clean text called toxic weighs against a toxic one that is missed, in calibration.
WRONG = 4
#: Rows of either class that a language needs for a threshold of its own.
LEAST_ROWS = 10
#: Bins of scores for each unit of log-odds, in calibration.
BINS = 64
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~""", np.uint8))


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3 bucket numbers, first word of each row)."""
    words = Words(texts)
    if len(words.start):
        for _ in range(3):
            longer = words.end - words.start > 1
            words.end = words.end - (longer & PUNCTUATION[words.data[words.end - 1]])
            longer = words.end - words.start > 1
            words.start = words.start + (longer & PUNCTUATION[words.data[words.start]])
    whole, *lead = words.hashes(lower=True, lead=LEAD)
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int64) for h in (whole, *lead)], axis=1), words.first


def sample_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_buckets`` of a list, by slices: the driver holds four bytes a number and no more than a slice of anything else."""
    numbers, counts = [np.zeros((0, 3), np.int32)], [np.zeros(1, np.int64)]
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SAMPLE_CHARS):
            size += len(texts[b])
            b += 1
        buckets, first = word_buckets(pa.array(texts[a:b], pa.large_string()))
        numbers.append(buckets.astype(np.int32))
        counts.append(np.diff(first))
        a = b
    return np.concatenate(numbers), np.cumsum(np.concatenate(counts))


@dataclass
class Model:
    """The parameters; ``embedding`` is one table for the three kinds of buckets, with a zero row last."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    trained: bool = True

    @staticmethod
    def new(seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        n = FILTERS * len(WIDTHS)
        embedding = rng.normal(0, 0.1, (3 * BUCKETS + 1, DIM)).astype(np.float32)
        embedding[-1] = 0
        return Model(embedding, filters, np.full(n, 0.1, np.float32), rng.normal(0, 0.3, n).astype(np.float32), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def layout(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of table numbers, ``PAD`` zero rows after each text; the first row and the number of windows of each text."""
        count = np.diff(first)
        at = first[:-1] + PAD * np.arange(len(count))
        rows = np.full((int(count.sum()) + PAD * len(count), 3), 3 * BUCKETS, np.int64)
        place = np.repeat(at - first[:-1], count) + np.arange(len(buckets))
        rows[place] = buckets + np.array([0, BUCKETS, 2 * BUCKETS])
        return rows, at, count + 1

    def maxima(self, rows: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedded rows, all windows' responses, each text's maxima)."""
        x = self.embedding[rows[:, 0]]
        x += self.embedding[rows[:, 1]]
        x += self.embedding[rows[:, 2]]
        n = len(x) - PAD + 1
        y = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for w, f in enumerate(self.filters):
            part = x[:n] @ f[0]
            for j in range(1, len(f)):
                part += x[j : j + n] @ f[j]
            y[:, w * FILTERS : (w + 1) * FILTERS] = part
        edges = np.stack([at, at + windows], axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= n else edges
        return x, y, np.maximum.reduceat(y, edges, axis=0)[::2]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.trained or not len(texts):
            return np.zeros(len(texts))
        rows, at, windows = self.layout(*word_buckets(texts))
        top = np.maximum(self.maxima(rows, at, windows)[2] + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip((top @ self.out + self.out_bias).astype(np.float64), -30, 30)))


@dataclass
class Gradients:
    """Slopes of the mean weighted loss: of ``Model.params`` and of the embedding rows ``numbers``."""

    params: list[np.ndarray]
    numbers: np.ndarray
    embedding: np.ndarray


def gradients(model: Model, buckets: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> Gradients:
    """A filter's gradient flows to its maximum alone."""
    rows, at, windows = model.layout(buckets, first)
    x, y, top = model.maxima(rows, at, windows)
    z = top + model.bias
    h = np.maximum(z, 0)
    score = 1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30)))
    g = ((score - labels) * weight / len(labels)).astype(np.float32)
    g_z = (g[:, None] * model.out) * (z > 0)
    where = np.empty(top.shape, np.int64)
    for i in range(len(labels)):
        where[i] = at[i] + y[at[i] : at[i] + windows[i]].argmax(axis=0)
    g_filters = [np.zeros_like(f) for f in model.filters]
    touched, flows = [], []
    for w, f in enumerate(model.filters):
        span = slice(w * FILTERS, (w + 1) * FILTERS)
        for j in range(len(f)):
            g_filters[w][j] = np.einsum("nfd,nf->df", x[where[:, span] + j], g_z[:, span])
            flow = g_z[:, span, None] * f[j].T[None]
            touched.append((where[:, span] + j).ravel())
            flows.append(flow.reshape(-1, DIM))
    numbers, place = np.unique(rows[np.concatenate(touched)].ravel(), return_inverse=True)
    grad = np.zeros((len(numbers), DIM), np.float32)
    np.add.at(grad, place, np.repeat(np.concatenate(flows), 3, axis=0))
    keep = numbers < 3 * BUCKETS
    return Gradients([*g_filters, g_z.sum(0), h.T @ g, g.sum(keepdims=True)], numbers[keep], grad[keep])


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit by Adam on the logistic loss."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    buckets, first = sample_buckets(texts)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.params()]
    m_e, v_e = np.zeros_like(model.embedding), np.zeros_like(model.embedding)
    met_buckets = np.zeros(len(model.embedding), bool)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            cut = np.concatenate([buckets[first[i] : first[i + 1]] for i in own])
            starts = np.concatenate([[0], np.cumsum(first[own + 1] - first[own])])
            found = gradients(model, cut, starts, labels[own], weight[own])
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, d, (m, v) in zip(model.params(), found.params, moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * fix * m / (np.sqrt(v) + 1e-8)
            numbers, grad = found.numbers, found.embedding
            met_buckets[numbers] = True
            m_e[numbers] += 0.1 * (grad - m_e[numbers])
            v_e[numbers] += 0.001 * (grad * grad - v_e[numbers])
            model.embedding[numbers] -= rate * fix * m_e[numbers] / (np.sqrt(v_e[numbers]) + 1e-8)
    model.embedding[~met_buckets] = 0
    return model


def best_cut(lowest: np.ndarray, highest: np.ndarray, ones: np.ndarray, zeros: np.ndarray, least: int = 1) -> float | None:
    """The middle of the threshold range with the highest recall less ``WRONG`` times the false-positive rate.

    Bins of scores, descending: lowest and highest score, rows of either class. None with fewer than ``least`` rows of a class.
    """
    n1, n0 = int(ones.sum()), int(zeros.sum())
    if min(n0, n1) < least:
        return None
    k = int((np.cumsum(ones) / n1 - WRONG * np.cumsum(zeros) / n0).argmax())
    below = highest[k + 1] if k + 1 < len(highest) else 0.0
    return float(np.clip((lowest[k] + below) / 2, 0.2, 0.8))


def best_threshold(scores: np.ndarray, labels: np.ndarray, least: int = 1) -> float | None:
    """``best_cut`` where each distinct score is a bin: a threshold cannot part equal scores."""
    met, place = np.unique(-scores, return_inverse=True)
    ones = np.bincount(place, weights=labels == 1)
    return best_cut(-met, -met, ones, np.bincount(place) - ones, least)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(1))


def left_out(rows: list) -> np.ndarray:
    """Which of the sampled rows calibration keeps: of each language and class a fifth, evenly, and ``LEAST_ROWS`` if that is at most half."""
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        groups.setdefault((r.lang, r.toxic), []).append(i)
    out = np.zeros(len(rows), bool)
    for own in groups.values():
        n = len(own)
        h = max(n // 5, min(LEAST_ROWS, n // 2))
        out[[i for k, i in enumerate(own) if (k + 1) * h // n > k * h // n]] = True
    return out


def score_bins(docs: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """(lang, bin, ones, zeros): counts of the scores of the labelled rows ``known`` (doc_id, toxic), each document once."""
    told = scored(docs.select("doc_id", "text", "lang"), model).select("doc_id", "lang", "score").where(F.col("doc_id").isNotNull())
    met = told.join(known, "doc_id").groupBy("doc_id").agg(F.max(F.struct("score", "lang", "toxic")).alias("r")).select("r.*")
    odds = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * BINS)
    return met.groupBy("lang", odds.alias("bin")).agg(F.sum((F.col("toxic") == 1).cast("long")).alias("ones"), F.sum((F.col("toxic") == 0).cast("long")).alias("zeros"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out, calibrate on all others of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("mixed", F.xxhash64("doc_id"))
    # lengths come before the limit, so that long texts don't shrink the sample
    own = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")).where(F.col("chars") <= most_chars).groupBy("doc_id").agg(F.min("chars").alias("chars"))
    short = known.join(own, "doc_id")
    sample = [short.where(short["toxic"] == k).orderBy("mixed", "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(sample[0].unionByName(sample[1]).select("doc_id", "toxic", "mixed"))  # at most 2 * per_class rows
    texts = docs.select("doc_id", "text", "lang").where(F.length(F.coalesce("text", F.lit(""))) <= most_chars)
    rows = texts.join(ids, "doc_id").groupBy("doc_id", "toxic", "mixed").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "t.*", "toxic", "mixed").collect()
    rows.sort(key=lambda r: (r.mixed, r.toxic))
    labels_of = np.array([r.toxic for r in rows], np.float32)
    if len(set(labels_of)) < 2:
        model = Model.new()
        model.trained = False
        return model
    kept = left_out(rows)
    trained_on, texts = [(r.doc_id,) for r, k in zip(rows, kept, strict=True) if not k], [r.text or "" for r, k in zip(rows, kept, strict=True) if not k]
    del rows
    model = train(texts, labels_of[~kept])
    del texts
    released()
    used = docs.sparkSession.createDataFrame(trained_on, T.StructType([T.StructField("doc_id", known.schema["doc_id"].dataType)]))
    rest = known.where(F.col("toxic").isin(0, 1)).join(F.broadcast(used), "doc_id", "left_anti").select("doc_id", "toxic")
    bins = sorted(((r.bin, r.lang, r.ones, r.zeros) for r in score_bins(docs, rest, model).collect()), key=lambda r: -r[0])

    def limit_of(own: list[tuple], shift: float, least: int) -> float | None:
        sums: dict[int, np.ndarray] = {}
        for k, _, *n in own:
            sums[k] = sums.get(k, 0) + np.array(n)
        at, n = np.array(list(sums)), np.array(list(sums.values())).reshape(-1, 2)
        lowest, highest = (1 / (1 + np.exp(shift - edge / BINS)) for edge in (at, at + 1))
        return best_cut(lowest, highest, n[:, 0], n[:, 1], least)

    shift = 0.0
    if (limit := limit_of(bins, shift, 1)) is not None:  # the calibrated threshold becomes a score of 0.5
        shift = float(np.log(limit / (1 - limit)))
        model.out_bias -= np.float32(shift)
    by_lang: dict[str, list[tuple]] = {}
    for r in bins:
        if r[1] is not None:
            by_lang.setdefault(r[1], []).append(r)
    for lang, own in by_lang.items():
        if (found := limit_of(own, shift, LEAST_ROWS)) is not None:
            model.thresholds[lang] = found
    return model


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score, toxic_verdict): each row of ``docs`` as a struct, its score, and the verdict by the threshold of its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(whole(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for part in slices(pa.RecordBatch.from_arrays([rows, pc.struct_field(rows, "text")], names=["row", "text"]), "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(shared.value.scores(part.column("text")), pa.float64())], names=["row", "score"])

    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    limits = F.when(F.lit(False), F.lit(model.threshold))
    for lang, value in sorted(model.thresholds.items()):
        limits = limits.when(F.col("row").getField("lang") == lang, F.lit(value))
    limits = limits.otherwise(F.lit(model.threshold))
    return plain.mapInArrow(run, schema).select("row", "score", (F.col("score") >= limits).alias("toxic_verdict"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``toxic_verdict``."""
    names = [c for c in docs.columns if c not in ("score", "toxic_verdict")]
    return judged(docs, model).select(*unpacked(F.col("row"), names), "score", "toxic_verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``; verdict uses the languages' thresholds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select("doc_id", "text", "lang"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_verdict",
    )


SQL = None
