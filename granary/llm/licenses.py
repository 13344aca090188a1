"""Licence scans in DataFrame functions only: TF-IDF cosine to templates, then inheritance by directory.

Every line of a file is a unit, so is every block of lines that lines without letters or digits set apart (a comment
header, a paragraph), and so is the whole text of a licence file. Terms are lower-case
runs of letters, digits and dots that end in a letter or digit, so comment marks don't count. A term's weight is its count times its idf,
ln((1 + N) / (1 + df)) + 1, with df and N counted over all files, for all terms. A unit's licence is that of the template of
the highest cosine if that is ``LEAST`` or more, a file's own licence that of its best unit.
A file without one inherits from the nearest ancestor directory that holds a licence file
with a licence.

Plan: df is counted in one pass, by partial sums, and written, one row per term. With the templates' weights known, each
template has terms without which no unit can reach ``LEAST`` - the rest of its terms are too light - so a second pass sends
on only units that hold one of them; this loses no unit. Their terms are counted by partial sums and met by their df, terms
that very many units hold as ``common.joined_evenly`` tells; templates, a fixed table, are broadcast. Texts are never
shuffled. Inheritance is resolved once for each distinct directory by an equi-join of its ancestors
with the licence directories.

Defined cases: null and empty texts have no units; a very long text without blank lines is one block; a null path has no directory
and inherits nothing, a null key is a key of its own; rows that stand twice each return a row, as their counts scale and their
cosines stay, and different texts of one key are judged apart; ties go to the earlier
template, and among licence files of a directory to the better score, then the smaller path; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_evenly, written
from .licence_texts import TEMPLATES

Templates = tuple[tuple[str, str], ...]
#: A term.
TERM = "[a-z0-9.]*[a-z0-9]"
#: What sets blocks of lines apart.
BETWEEN = "\n[^A-Za-z0-9]*\n"
#: Names of licence files.
LICENCE_FILES = ("LICENSE", "LICENCE", "COPYING")
LEAST = 0.7


def plain_terms(text: str) -> list[str]:
    """The terms of a template; ``terms`` is the same as a column."""
    return re.findall(TERM, text.lower())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def frequencies(files: DataFrame) -> DataFrame:
    """(term, df): in how many of the files each term stands."""
    return files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def needed(template: str, idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a unit must have one to reach ``least``: the others together are too light. Common terms are left to the others."""
    count = Counter(plain_terms(template))
    total, light, out = sum((c * idf[t]) ** 2 for t, c in count.items()), 0.0, []
    for t in sorted(count, key=lambda t: (idf[t], t)):
        weight = (count[t] * idf[t]) ** 2
        if light + weight < least * least * total * (1 - 1e-6):
            light += weight
        else:
            out.append(t)
    return out


def is_licence_file(path: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(path, F.lit("")), "([^/.]*)(\\.[^/]*)?$", 1)).isin(*LICENCE_FILES)


def units(files: DataFrame, some: Column) -> DataFrame:
    """(key, content, block, line, terms): the blocks of lines of each text, all of a licence file's, and the lines of blocks of several (``line`` 0 and up).

    Only units that hold one of the terms ``some``; a line does only if its block does, so terms are taken of blocks first.
    """
    text = F.coalesce("text", F.lit(""))
    parts = F.transform(F.split(text, BETWEEN), lambda b: F.struct(b.alias("text"), F.lit(False).alias("all")))
    every = F.array(F.struct(text.alias("text"), F.lit(True).alias("all")))
    blocks = F.concat(parts, F.when(is_licence_file(F.col("path")), every).otherwise(F.slice(parts, 1, 0)))
    each = files.select("key", "content", F.posexplode(blocks).alias("block", "b")).select("key", "content", "block", "b.*").withColumn("terms", terms(F.col("text")))
    held = each.where(F.arrays_overlap("terms", some))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), terms(x).alias("terms")))
    of_lines = F.when(~F.col("all") & F.contains(F.btrim("text", F.lit("\n")), F.lit("\n")), F.filter(lines, lambda x: F.arrays_overlap(x["terms"], some))).otherwise(F.slice(lines, 1, 0))
    unit = F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.col("terms").alias("terms"))), of_lines)).alias("unit")
    return held.select("key", "content", "block", unit).select("key", "content", "block", "unit.*")


def own_licences(files: DataFrame, templates: Templates, least: float = LEAST) -> DataFrame:
    """(key, content, own_score, own_license) of the files (key, path, text, content) that have a licence of their own."""
    spark = files.sparkSession
    n = files.count()
    df = written(frequencies(files), "frequencies")
    vocabulary = sorted({t for _, x in templates for t in plain_terms(x)})
    known = {r.term: r.df for r in df.where(F.col("term").isin(vocabulary)).collect()}  # as large as the templates
    idf = {t: math.log((1 + n) / (1 + known.get(t, 0))) + 1 for t in vocabulary}
    must = sorted({t for _, x in templates for t in needed(x, idf, least)})
    unit = ["key", "content", "block", "line"]
    held = units(files, F.array(*map(F.lit, must)))
    counted = written(held.select(*unit, F.explode("terms").alias("term")).groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("tf")), "counted")
    met = counted.groupBy("term").agg(F.count(F.lit(1)).alias("rows")).join(df, "term")
    weighed = joined_evenly(counted, written(met, "met"), ["term"], "rows", counted.count(), F.struct(*unit))
    weighed = weighed.withColumn("w", F.col("tf") * (F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1))
    vectors = [{t: c * idf[t] for t, c in Counter(plain_terms(x)).items()} for _, x in templates]
    norms = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    table = F.broadcast(spark.createDataFrame([(t, k, w / norms[k]) for k, v in enumerate(vectors) for t, w in sorted(v.items())], "term string, k int, v double"))
    of_unit = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).select(*[F.col(c).alias(f"u_{c}") for c in unit], "norm")
    dots = weighed.join(table, "term").groupBy(*unit, "k").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    same = F.col("key").eqNullSafe(F.col("u_key")) & (F.col("content") == F.col("u_content")) & (F.col("block") == F.col("u_block")) & (F.col("line") == F.col("u_line"))
    scored = dots.join(of_unit, same)
    scored = scored.select("key", "content", F.struct(F.round(F.col("dot") / F.col("norm"), 6).alias("score"), (-F.col("k")).alias("k")).alias("best"))
    found = scored.where(F.col("best.score") >= least).groupBy("key", "content").agg(F.max("best").alias("best"))
    name = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), (1 - F.col("best.k")).cast("int"))
    return found.select("key", "content", F.col("best.score").alias("own_score"), name.alias("own_license"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates: Templates = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``files`` has key, path and text; returns key, path, own and inherited licence, and the one that holds."""
    files = files.select("key", "path", "text", F.xxhash64("path", "text").alias("content"))
    own = own_licences(files, templates, least).select(F.col("key").alias("o_key"), F.col("content").alias("o_content"), "own_score", "own_license")
    listed = files.select("key", "path", "content", parent(F.col("path")).alias("dir"), is_licence_file(F.col("path")).alias("is_file"))
    listed = listed.join(own, F.col("key").eqNullSafe(F.col("o_key")) & (F.col("content") == F.col("o_content")), "left")
    given = listed.where(F.col("is_file") & F.col("own_license").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("g"))
    given = given.select(F.col("dir").alias("ancestor"), F.col("g.own_license").alias("inherited_license"), F.col("g.path").alias("inherited_from"))
    dirs = listed.where(F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    above = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(up)).alias("ancestor"))
    near = above.join(given, "ancestor").groupBy("dir").agg(F.max_by(F.struct("inherited_license", "inherited_from"), F.length("ancestor")).alias("n"))
    out = listed.join(near.select("dir", "n.*"), "dir", "left")
    return out.select("key", "path", "own_license", "own_score", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: <source>/<thousand>/<fifty>/<id>.txt; the first of a thousand or of fifty is that directory's LICENSE."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    top = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), part(1000))
    low = F.concat(top, F.lit("/"), part(50))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat(low, F.lit("/LICENSE"))).otherwise(F.concat(low, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all of ``documents``."""
    return scan(document_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("key", "doc_id")


def _sql() -> str:
    def split(column: str) -> str:
        return f"regexp_extract_all(lower({column}), '{TERM}')"

    rows = ", ".join(f"({k}, '{name}', '{t}', CAST({c} AS DOUBLE))" for k, (name, x) in enumerate(TEMPLATES) for t, c in sorted(Counter(plain_terms(x)).items()))
    return rf"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(source, 'unknown') || '/' || (doc_id // 1000) || CASE WHEN doc_id % 1000 = 0 THEN '' ELSE '/' || (doc_id // 50) END AS dir,
    doc_id % 50 = 0 AS is_file, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name
  FROM documents),
template(k, license, term, n) AS (VALUES {rows}),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({split("text")}) AS term FROM files) GROUP BY term),
total AS (SELECT count(*) AS n FROM files),
tw AS (SELECT k, license, template.term, template.n * (ln((1 + total.n) / (1 + coalesce(df, 0))) + 1) AS w FROM template LEFT JOIN df USING (term), total),
tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tw GROUP BY k),
units AS (
  SELECT doc_id, i, l[i] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) || [b FOR b IN string_split_regex(text, '\n[^A-Za-z0-9]*\n') IF contains(trim(b, chr(10)), chr(10))] || CASE WHEN is_file THEN [text] ELSE [] END AS l FROM files))),
tf AS (SELECT doc_id, i, term, count(*) AS tf FROM (SELECT doc_id, i, unnest({split("line")}) AS term FROM units) GROUP BY ALL),
uw AS (SELECT doc_id, i, term, tf * (ln((1 + total.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), total),
un AS (SELECT doc_id, i, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
cos AS (
  SELECT doc_id, k, license, round(sum(uw.w * tw.w) / any_value(un.norm * tn.norm), 6) AS score
  FROM uw JOIN tw USING (term) JOIN un USING (doc_id, i) JOIN tn USING (k) GROUP BY doc_id, i, k, license),
own AS (SELECT doc_id, score AS own_score, license AS own_license FROM cos WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1),
listed AS (SELECT doc_id, dir || '/' || name AS path, dir, is_file, own_score, own_license FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT dir AS ancestor, path AS inherited_from, own_license AS inherited_license FROM listed WHERE is_file AND own_license IS NOT NULL),
near AS (
  SELECT doc_id, inherited_from, inherited_license FROM listed JOIN given ON listed.dir = ancestor OR starts_with(listed.dir, ancestor || '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(ancestor) DESC) = 1)
SELECT doc_id, path, own_license, own_score, inherited_license, inherited_from, coalesce(own_license, inherited_license) AS license
FROM listed LEFT JOIN near USING (doc_id)
"""


SQL = _sql()
