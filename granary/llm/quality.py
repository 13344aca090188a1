"""Quality rules by cross-document line frequency, in DataFrame functions only.

Every line of a text is normalised (lower case, digits to 0, runs of blanks to
one space, ends trimmed) and hashed. Per host, the distinct documents that hold
a line are counted; a line that more than ``max_docs`` documents hold and more than
``max_share`` of the host's documents, or more than ``most_docs`` in any host, is boilerplate and is removed. A document that keeps
less than ``least_left`` of its words is depleted and rejected.

Plan: the texts are never shuffled. A first pass counts (host, line, document) as three hashes,
summed before they are shuffled. A second one meets the lines with the frequent ones - at most all lines divided by
``max_docs`` -, which are broadcast where there are ``BROADCAST_ROWS`` of them at most, and met by a join dealt by
``common.joined_evenly`` beyond; only removed lines are shuffled, as ids and counts.

Defined cases: null and empty texts have no words or lines and fail the base rules; a very long text is many lines; a null
host is a host of its own; a null doc_id is a document of its own for each text; rows that are wholly equal count as one document but
each returns a row; a count equal to a limit is under it; an empty table returns no rows; further columns of the input,
whatever their names, are ignored by ``line_rules`` and kept by ``clean_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_evenly, unpacked, whole, written
from .native import let, word_array

SYMBOLS = "#*$%&|<>"
MAX_DOCS = 20
MAX_SHARE = 0.005
#: More documents than this make a line boilerplate in a host of any size, or a hot host would be judged ever more loosely.
MOST_DOCS = 1000
LEAST_LEFT = 0.3
#: Frequent lines, of 16 bytes, that are broadcast at most.
BROADCAST_ROWS = 1 << 18
_BLANKS = " \t\x0b\f\r"


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more among ``words``, the first included.

    Windows are compared by 64-bit hashes. Only texts with a repeated window pay for
    the sort that finds the places.
    """

    def covered(triples: Column) -> Column:
        def places(s: Column) -> Column:
            marked = F.transform(
                s,
                lambda x, k: F.struct(
                    x["i"].alias("p"),
                    (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
                ),
            )
            return F.sort_array(F.transform(F.filter(marked, lambda y: y["twice"]), lambda y: y["p"]))

        ordered = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(ordered, places),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def of(w: Column) -> Column:
        triples = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(triples, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))

    return let(words, of)


def base_stats(text: Column) -> Column:
    """A struct of the counts that need only the text itself."""
    t = F.coalesce(text, F.lit(""))
    of_words = let(word_array(t), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    full_lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    dup = let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        of_words,
        lambda w: F.struct(
            w["n_words"].cast("long").alias("n_words"),
            F.length(F.translate(t, _BLANKS + "\n", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            w["n_repeat_words"].cast("long").alias("n_repeat_words"),
        ),
    )


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, in order; blank lines are empty strings."""
    flat = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "123456789", "000000000"), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, host, content, other): host and content as hashes; ``other`` tells documents without an id apart."""
    host = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    return docs.select("doc_id", "text", host.alias("host"), F.xxhash64("source", "text").alias("content")).withColumn("other", F.when(F.col("doc_id").isNull(), F.col("content")))


def _lines(keyed: DataFrame) -> DataFrame:
    """(host, doc_id, other, content, place, line, words) of every line that is not blank."""
    each = keyed.select("host", "doc_id", "other", "content", F.posexplode(normal_lines(F.col("text"))).alias("place", "line")).where(F.col("line") != "")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return each.select("host", "doc_id", "other", "content", "place", F.xxhash64("line").alias("line"), words.alias("words"))


def frequent_in(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, most_docs: int = MOST_DOCS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, content, line, words, place) of every line that is removed from its document."""
    keyed = _keyed(docs)
    hosts = keyed.select("host", "doc_id", "other").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = _lines(keyed).select("host", "line", "doc_id", "other").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs"))
    limit = F.least(F.greatest(F.lit(float(max_docs)), F.col("host_docs") * F.lit(max_share)), F.lit(float(most_docs)))
    frequent = counts.where(F.col("line_docs") > min(max_docs, most_docs)).join(hosts, "host").where(F.col("line_docs") > limit)
    frequent = written(frequent.select("host", "line", "line_docs"), "frequent")
    n, rows = frequent.agg(F.count(F.lit(1)), F.sum("line_docs")).first()
    lines = _lines(keyed)
    if n <= broadcast_rows:
        gone = lines.join(F.broadcast(frequent.select("host", "line")), ["host", "line"])
    else:
        gone = joined_evenly(lines, frequent, ["host", "line"], "line_docs", rows, F.struct("doc_id", "place"))
    return gone.select("doc_id", "content", "line", "words", "place").distinct()


def line_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT, most_docs: int = MOST_DOCS) -> DataFrame:
    """One row per input row: base counts, what line frequency removes, and the verdicts."""
    removed = (
        frequent_in(docs, max_docs, max_share, most_docs)
        .groupBy(F.col("doc_id").alias("r_doc"), F.col("content").alias("r_content"))
        .agg(F.sum("words").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"))
    )
    stats = _keyed(docs).select("doc_id", "content", base_stats(F.col("text")).alias("s")).select("doc_id", "content", "s.*")
    joined = stats.join(removed, stats["doc_id"].eqNullSafe(removed["r_doc"]) & (stats["content"] == removed["r_content"]), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    depleted = (F.col("n_words") - gone) < F.col("n_words") * F.lit(least_left)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("removed_words"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )


def clean_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """The documents with their frequent lines taken out of ``text``; all columns stay."""
    gone = (
        frequent_in(docs, max_docs, max_share, most_docs)
        .groupBy(F.col("doc_id").alias("gone_doc"), F.col("content").alias("gone_content"))
        .agg(F.sort_array(F.collect_list("place")).alias("gone"))
    )
    own = docs.select(whole(docs).alias("row"), "doc_id", F.xxhash64("source", "text").alias("content"))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.col("content") == F.col("gone_content")), "left")
    text = F.col("row").getField("text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(left).alias("text")
    return joined.select(*[cleaned if c == "text" else x for c, x in zip(docs.columns, unpacked(F.col("row"), docs.columns), strict=True)])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-frequency rules over all of ``documents``."""
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents),
keyed AS (SELECT doc_id, t, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS host FROM d),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t FROM keyed),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM keyed),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM raw_lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (
  SELECT doc_id, host, trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM keyed)),
lines AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM norm WHERE line <> ''),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM keyed GROUP BY host),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS line_docs FROM lines GROUP BY host, line) JOIN hosts USING (host)
  WHERE line_docs > least(greatest({MAX_DOCS}, host_docs * {MAX_SHARE}), {MOST_DOCS})),
removed AS (
  SELECT doc_id, sum(words) AS removed_words, count(*) AS removed_lines FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
stats AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT *, NOT base_failed AND n_words - removed_words >= n_words * {LEAST_LEFT} AS kept FROM judged
"""
