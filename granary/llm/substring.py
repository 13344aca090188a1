"""Substring deduplication by repeated-phrase automata.

A word goes if a window of ``window`` words that covers it also starts in a document with
a smaller id. All windows are judged on the input.

1. Confirm recurring passages. The smallest ``ANCHOR``-word hash in a window is the window's
   anchor, so equal windows have equal anchors and about a quarter of the words start one. Every
   document's anchors are grouped; those of two different texts or more recur. Runs of words under
   windows with a recurring anchor are cut out as parts of at most ``PART`` windows, and only their
   windows are grouped, each with the smallest document that holds it and that document's part. The
   confirmed windows that a part is the first to hold make up its passages.
2. Compile sharded automata. Passages are dealt to shards by document and region, so a shard has about
   ``SHARD`` windows however many the corpus has. A shard's Aho-Corasick automaton is compiled from
   the windows of its passages, spelled in a small alphabet, each with the smallest document that holds it.
3. Stream. Each part runs through the automata of the shards that its confirmed windows belong to; parts
   that hold none, and documents without parts, cannot match. Every occurrence of a window of a smaller
   document is marked. A shard that very many parts run through is compiled once for each ``SALT_EACH`` of them.

Documents that equal a smaller one word by word are copies as a whole, and skip all three steps: an
automaton would find all their windows.

Plan: a part is sent to a shard once, however many windows they share, and no passage is sent to a document; so what is
shuffled grows with the words under recurring anchors. Hot anchors, windows and classes of copies are met as
``common.joined_evenly`` tells. Texts are shuffled twice, to the anchors and to the marks; no group of documents is gathered.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; a very long text is many parts,
though it is one row; rows that stand twice have one id and don't remove each other, nor do different texts of one id; rows of a null
id neither lose nor remove words; ties cannot arise, as the smallest id wins; an empty table gives no rows; further columns are
kept by ``deduplicated``, whatever their names, but for those of its own columns, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, files_for, joined_evenly, sequence_hashes, sized_partitions, slices, unpacked, whole, window_hashes, written
from .native import let, word_array

WINDOW = 13
ANCHOR = 7
#: Windows in a part of a document at most, and words of a document in a region of it.
PART = 256
REGION = 512
#: Letters of a shard's windows, about; an automaton has that many nodes at most.
SHARD_NODES = 1 << 18
#: Parts that one automaton streams; a shard with more is compiled again for the next ones.
SALT_EACH = 4096
#: In the automaton a word is two letters, of 6 and 18 bits of its hash: an automaton's node seeks among its children one by
#: one, so whole words as letters would make its root slow. Matches are held against whole hashes.
LETTERS = 2
#: The columns that the operator adds.
OWN = ("n_words", "n_removed", "removed_spans", "kept_words")


def anchors_of(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, first word) of each window."""
    h, _, place = window_hashes(hashes, first, anchor)
    at = np.full(len(hashes) + 1, -1)
    at[place] = np.arange(len(place))
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(row[:n] == row[window - 1 :])
    least = h[at[start]]
    for j in range(1, window - anchor + 1):
        least = np.minimum(least, h[at[start + j]])
    return least, row[start], start


def covered(n: int, start: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The runs of words that windows at ``start`` cover, of ``n`` words."""
    if not len(start):
        return []
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    inside = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def sketches(own: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, content, one, two, n, anchors): two hashes of the words of each text, their number, and its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                one, two = sequence_hashes(words, lower=False)
                found, row, _ = anchors_of(words.hashes(), words.first, window, anchor)
                found, row = distinct_in_rows(found, row)
                edges = np.searchsorted(row, np.arange(words.n_rows + 1)).astype(np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.view(np.int64)))
                columns = [part.column("doc_id"), part.column("content"), pa.array(one), pa.array(two), pa.array(words.count().astype(np.int64)), anchors]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "one", "two", "n", "anchors"])

    return own.select("doc_id", "content", "text").mapInArrow(run, "doc_id long, content long, one long, two long, n long, anchors array<long>")


def distinct_in_rows(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once for each row; ``row`` ascends."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(hashes)])
    return hashes[new], row[new]


def runs(chosen: list[np.ndarray], words: Words, window: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, first word, text) of the runs of words under each row's ``chosen`` windows, cut to ``most`` windows each."""
    for i, start in enumerate(chosen):
        first = int(words.first[i])
        for a, b in covered(int(words.first[i + 1]) - first, start, window):
            for c in range(a, b - window + 1, most):
                end = min(b, c + most + window - 1)
                yield i, c, words.data[words.start[first + c] : words.end[first + end - 1]].tobytes()


def parts(texts: DataFrame, window: int, anchor: int, most: int = PART) -> DataFrame:
    """(doc_id, content, at, part): the runs of words under windows with one of the row's ``anchors``; ``at`` is a run's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                words = Words(cut.column("text"))
                found, row, start = anchors_of(words.hashes(), words.first, window, anchor)
                edges = np.searchsorted(row, np.arange(words.n_rows + 1))
                own = cut.column("anchors")
                hot = [start[a:b][np.isin(found[a:b].view(np.int64), own[i].values.to_numpy())] - words.first[i] for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                rows = list(runs(hot, words, window, most))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id").take(at), cut.column("content").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
                    names=["doc_id", "content", "at", "part"],
                )

    return texts.select("doc_id", "content", "anchors", "text").mapInArrow(run, "doc_id long, content long, at long, part string")


def window_rows(cut: DataFrame, window: int, bits: int) -> DataFrame:
    """(hash, place, doc_id, at) of every window in the parts, once for each part.

    ``place`` is the document and, in its lowest ``bits``, the region of the part: its minimum is that of the smallest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "part"):
                words = Words(part.column("part"))
                h, row, _ = window_hashes(words.hashes(), words.first, window)
                h, row = distinct_in_rows(h, row)
                doc, at = (part.column(k).to_numpy()[row] for k in ("doc_id", "at"))
                place = (doc << bits) | np.minimum(at // REGION, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), place, doc, at)], names=["hash", "place", "doc_id", "at"])

    return cut.select("doc_id", "at", "part").mapInArrow(run, "hash long, place long, doc_id long, at long")


def passages(cut: DataFrame, window: int) -> DataFrame:
    """(shard, first, passage): runs of the windows in a row's ``hashes``; a window that repeats in a part counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "part"):
                words = Words(part.column("part"))
                h, row, start = window_hashes(words.hashes(), words.first, window)
                edges = np.searchsorted(row, np.arange(words.n_rows + 1))
                own, hot = part.column("hashes"), []
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    mine = h[a:b].view(np.int64)
                    fresh = np.zeros(len(mine), bool)
                    fresh[np.unique(mine, return_index=True)[1]] = True
                    hot.append(start[a:b][fresh & np.isin(mine, own[i].values.to_numpy())] - words.first[i])
                rows = list(runs(hot, words, window, 1 << 30))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("shard").take(at), part.column("doc_id").take(at), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["shard", "first", "passage"]
                )

    return cut.select("shard", "doc_id", "part", "hashes").mapInArrow(run, "shard long, first long, passage string")


def spelled(hashes: np.ndarray) -> str:
    """``LETTERS`` letters for each word; a word's first letter is of a range of its own, and neither is a surrogate."""
    out = np.empty((len(hashes), LETTERS), "<u4")
    out[:, 0] = (hashes & np.uint64(63)) + np.uint64(128)
    out[:, 1] = ((hashes >> np.uint64(6)) & np.uint64((1 << 18) - 1)) + np.uint64(0xE000)
    return out.tobytes().decode("utf-32-le")


class Automaton:
    """An Aho-Corasick automaton of the windows of passages, over spelled words."""

    def __init__(self, window: int):
        self.window, self.owner = window, {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        self.ready = False

    def add(self, first: list[int], texts: pa.Array) -> None:
        """The windows of passages; ``first`` are the documents that hold them."""
        words = Words(texts)
        hashes = words.hashes()
        letters, width = spelled(hashes), LETTERS * self.window
        whole_hash, row, place = window_hashes(hashes, words.first, self.window)
        for h, i, p in zip(whole_hash.tolist(), row.tolist(), place.tolist(), strict=True):
            known, own = self.owner.get(h), first[i]
            if known is None or own < known:
                self.owner[h] = own
            if known is None:
                key = letters[LETTERS * p : LETTERS * p + width]
                self.automaton.add_word(key, (*self.automaton.get(key, ()), h))

    def spans(self, docs: list[int], texts: pa.Array) -> list[list[tuple[int, int]]]:
        """The runs of words of each text in windows of a document smaller than its own."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        words = Words(texts)
        hashes = words.hashes()
        whole_hash, _, place = window_hashes(hashes, words.first, self.window)
        at = np.zeros(len(hashes) + 1, np.uint64)
        at[place] = whole_hash
        out: list[list[tuple[int, int]]] = []
        if not self.owner:
            return [[] for _ in docs]
        letters = spelled(hashes)
        for i, doc in enumerate(docs):
            a, b = int(words.first[i]), int(words.first[i + 1])
            own, found = at[a:b].tolist(), []
            for last, spelled_so in self.automaton.iter(letters[LETTERS * a : LETTERS * b]):
                p = last // LETTERS - self.window + 1
                if own[p] in spelled_so and self.owner[own[p]] < doc:
                    found.append(p)
            out.append(covered(b - a, np.array(found, np.int64), self.window))
        return out


def streamed(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, content, a, b): the words ``a:b`` that go, from rows (shard, salt, kind, doc_id, content, at, part): passages of kind 0, then parts."""
    dealt = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, automaton = None, Automaton(window)
        for batch in batches:
            for part in slices(batch, "part"):
                keys = list(zip(*(part.column(k).to_pylist() for k in ("shard", "salt", "kind")), strict=True))
                cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if keys[a][:2] != unit:
                        unit, automaton = keys[a][:2], Automaton(window)
                    own = part.slice(a, b - a)
                    docs = own.column("doc_id").to_pylist()
                    if keys[a][2] == 0:
                        automaton.add(docs, own.column("part"))
                        continue
                    found = automaton.spans(docs, own.column("part"))
                    rows = [(d, c, at + x, at + y) for d, c, at, spans in zip(docs, own.column("content").to_pylist(), own.column("at").to_pylist(), found, strict=True) for x, y in spans]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "content", "a", "b"])

    return dealt.select("shard", "salt", "kind", "doc_id", "content", "at", "part").mapInArrow(run, "doc_id long, content long, a long, b long")


def routed(cut: DataFrame, window: int, files: int) -> DataFrame:
    """What ``streamed`` needs: each passage at its shard, and each part at the shards of its confirmed windows."""
    widest = cut.agg(F.max(F.greatest(F.col("doc_id"), -(F.col("doc_id") + 1)))).first()[0] or 0
    bits = max(0, min(32, 62 - int(widest).bit_length()))
    windows = window_rows(cut, window, bits)
    grouped = windows.groupBy("hash").agg(F.min("place").alias("place"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    first = lambda place: F.shiftright(place, bits)
    confirmed = written(grouped.where(first("place") < first("last")).select("hash", "place", "n"), "windows", files)
    n_windows, n_rows = (x or 0 for x in confirmed.agg(F.count(F.lit(1)), F.sum("n")).first())
    shards = sized_partitions(n_windows, SHARD_NODES // (LETTERS * window))
    # four regions that follow each other go to one shard
    shard = F.pmod(F.xxhash64(F.shiftright("place", 2)), F.lit(shards)).alias("shard")
    met = joined_evenly(windows.select("hash", "doc_id", "at"), confirmed, ["hash"], "n", n_rows, F.struct("doc_id", "at")).where(first("place") < F.col("doc_id"))
    routes = written(met.select("doc_id", "at", shard).distinct(), "routes", files)
    loads = routes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / SALT_EACH))
    salted = joined_evenly(routes, loads, ["shard"], "n", routes.count(), F.struct("doc_id", "at"))
    salted = salted.select("doc_id", "at", "shard", F.pmod(F.xxhash64("doc_id", "at"), F.col("salts")).alias("salt"))
    sent = cut.join(salted, ["doc_id", "at"]).select("shard", "salt", F.lit(1).alias("kind"), "doc_id", "content", "at", "part")
    firsts = confirmed.groupBy("place").agg(F.collect_list("hash").alias("hashes"))
    place = F.shiftleft("doc_id", bits).bitwiseOR(F.least(F.floor(F.col("at") / REGION), F.lit((1 << bits) - 1)))
    told = passages(cut.withColumn("place", place).join(firsts, "place").withColumn("shard", shard), window)
    told = told.join(loads.select("shard", F.sequence(F.lit(0).cast("long"), F.col("salts") - 1).alias("all")), "shard").withColumn("salt", F.explode("all"))
    told = told.select("shard", "salt", F.lit(0).alias("kind"), F.col("first").alias("doc_id"), F.lit(None).cast("long").alias("content"), F.lit(None).cast("long").alias("at"), F.col("passage").alias("part"))
    return told.unionByName(sent)


def removed_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(spans, copies) of ``docs`` (doc_id, content, text): the words ``a:b`` that go of a text, and the texts that go whole."""
    files = files_for(docs)
    own = docs.where(F.col("doc_id").isNotNull())
    listed = written(sketches(own, window, anchor).where(F.col("n") >= window), "sketches", files)
    classes = written(listed.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes", files)
    rows = listed.select("doc_id", "content", "one", "two")
    copies = joined_evenly(rows, classes, ["one", "two"], "rows", rows.count(), F.struct("doc_id", "content")).where("doc_id > rep").select("doc_id", "content").distinct()

    found = listed.select("doc_id", "one", F.explode("anchors").alias("anchor"))
    grouped = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("one").alias("s"), F.max("one").alias("t"), F.count(F.lit(1)).alias("n"))
    recurring = written(grouped.where("a < b AND s <> t").select("anchor", "n"), "anchors", files)
    firsts = classes.select(F.col("rep").alias("doc_id"), "one", "two")
    of_reps = listed.join(firsts, ["doc_id", "one", "two"], "left_semi").select("doc_id", F.explode("anchors").alias("anchor"))
    hits = joined_evenly(of_reps, recurring, ["anchor"], "n", recurring.agg(F.sum("n")).first()[0] or 0, F.col("doc_id")).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    cut = written(parts(own.join(hits, "doc_id"), window, anchor), "parts", files)
    return streamed(routed(cut, window, files), window), copies


def marked(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, n_words, n_removed, removed_spans, kept_words): each row of ``docs`` as a struct, and what ``deduplicated`` adds to it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    spans, copies = removed_spans(own, window, anchor)
    of_text = spans.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))).alias("spans"))
    told = of_text.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "content"], "full")
    plain = docs.select(whole(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"))
    met = plain.join(told, ["doc_id", "content"], "left").select("row", word_array(F.col("row").getField("text")).alias("words"), "spans", "copy")

    def merged(s):
        """Sorted spans with overlapping and adjoining ones as one."""
        step = lambda out, x: F.when(
            (F.size(out) > 0) & (F.coalesce(F.get(out, F.size(out) - 1)["b"], F.lit(-1)) >= x["a"]),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["a"].alias("a"), F.greatest(F.get(out, F.size(out) - 1)["b"], x["b"]).alias("b")))),
        ).otherwise(F.concat(out, F.array(x)))
        return F.aggregate(s, F.array().cast("array<struct<a:int,b:int>>"), step)

    n = F.size("words")
    gone = F.when(F.col("copy"), F.array(F.struct(F.lit(0).alias("a"), n.alias("b")))).when(F.col("spans").isNull(), F.array().cast("array<struct<a:int,b:int>>")).otherwise(merged(F.col("spans")))
    judged = met.select("row", "words", gone.alias("gone"))

    def left(g):
        """The words outside the spans: what lies between the end of one (or the start) and the next one."""
        ends = F.concat(F.array(F.lit(0)), F.transform(g, lambda x: x["b"]))
        starts = F.concat(F.transform(g, lambda x: x["a"]), F.array(n))
        between = F.zip_with(ends, starts, lambda a, b: F.slice("words", a + 1, b - a))
        return F.flatten(between)

    kept = F.when(F.size("gone") == 0, F.col("words")).otherwise(let(F.col("gone"), left))
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    as_lists = F.transform("gone", lambda x: F.array(x["a"], x["b"]))
    return judged.select("row", n.cast("long").alias("n_words"), removed.alias("n_removed"), as_lists.alias("removed_spans"), F.array_join(kept, " ").alias("kept_words"))


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``n_words``, ``removed_spans`` (words [start, end)), ``n_removed`` and ``kept_words``, joined by one space."""
    return marked(docs, window, anchor).select(*unpacked(F.col("row"), [c for c in docs.columns if c not in OWN]), *OWN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` without the 13-word windows that smaller documents hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


#: Windows by the words themselves, joined; no anchors, no automata.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, CAST(unnest(range(1, len(words) - 11)) AS INTEGER) AS i FROM w WHERE len(words) >= 13),
windows AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 12], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (h) WHERE owner < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, CAST(unnest(range(1, len(words) + 1)) AS BIGINT) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
