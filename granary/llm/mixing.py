"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating and
   share ``share`` of all words; a target stops at ``most`` times its source and the
   excess is reshared by weight until none is above. The loop brings two numbers to
   the driver each time round.
2. Schedule: slot ``i`` has the golden-ratio point frac((i + 0.5) * phi). Cumulative
   targets cut [0, 1) into one interval per source, and a point's interval names the
   slot's source. Intervals and points meet by an equi-join on grid cells. Slots are
   ranked per source in two levels (chunks of slots, then chunk offsets), so no window
   holds all slots of a hot source. A source that the points leave short of its target
   gets its last slots at the end of the schedule.
3. Blocks: each source's documents, shuffled by md5 of id and text, form a stream of
   words, which is cut into blocks of ``block`` words; the stream runs through again
   from its start when it ends. Slot ``k`` of a source takes block ``k``; the last one
   stops at the target. Offsets in the stream come from two levels too.

So the first slots of the schedule hold every source in proportion to its target, to within a
few blocks, wherever it is cut. ``mix`` tells the slots of each document's pieces; ``mixed_texts`` returns
the words taken, and each of its partitions in the order of the slots.

Plan: windows rank ids, sizes and slots only, at most ``MOST_LEVEL`` chunks or buckets of a source on the upper
level; texts are shuffled once, by ``mixed_texts``, and met by whole-row keys, rows that are wholly equal as one.

Defined cases: null and empty texts have size 0 and take nothing; a very long text is a run of blocks as any other; a null
source is a source, and rows of a null id are documents of their own; rows that stand twice are documents
of their own, as are different texts of one id; ties in the shuffled order go by id and size, and what still ties is equal; an empty
table returns no rows; further columns are ignored by ``mix`` and kept by ``mixed_texts``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, unpacked, whole, written
from .native import word_array, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 128
#: Documents of a source that one window orders, and slots that one window ranks, at least, and how many such groups at most.
BUCKET = 512
CHUNK = 1024
MOST_LEVEL = 1 << 16
#: The golden ratio's fraction.
PHI = 0.6180339887498949


def named(source: Column) -> Column:
    """A key that is never null: sources sort by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed; rows that differ in ``text`` differ in it."""
    return F.xxhash64(*[quoted(f.name) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, src, size, content, mixed) for each document; ``mixed`` orders its source's stream."""
    mixed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source", named(F.col("source")).alias("src"), word_count(F.col("text")).alias("size"), row_hash(docs).alias("content"), mixed.alias("mixed"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(src, source_size, weight, target): one row per source; the table grows with the sources alone."""
    place = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = written(sizes.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("double")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * most
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        capped, free = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total * share - (capped or 0)) / free if free else level
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.when(cap <= F.col("weight") * F.lit(level), cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def schedule(aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, src, k, from, to): slot takes words ``from:to`` of its source's stream, its ``k``-th block."""
    spark = aims.sparkSession
    n_sources, total = aims.agg(F.count(F.lit(1)), F.sum("target")).first()
    if not total:
        return aims.select(F.lit(0).cast("long").alias("slot"), "src", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to")).limit(0)
    cells = 1 << max(10, (4 * n_sources).bit_length())
    upto = F.sum("target").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    cut = aims.withColumn("hi", upto / F.lit(total)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0.0)))
    cut = cut.withColumn("hi", F.when(F.lead("src").over(Window.orderBy("src")).isNull(), F.lit(2.0)).otherwise(F.col("hi"))).where("target > 0 and lo < 1")
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    grid = cut.select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), last)).alias("cell"))
    n_slots = int(total / block) + 1
    point = (F.col("id") + 0.5) * F.lit(PHI)
    slots = spark.range(n_slots).withColumn("u", point - F.floor(point)).withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    drawn = slots.join(grid, "cell").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "src", F.floor(F.col("id") / max(CHUNK, n_slots // MOST_LEVEL)).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = counts.select("src", "chunk", before.alias("before"))
    ranked = (
        drawn.withColumn("in_chunk", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1)
        .join(offsets, ["src", "chunk"])
        .select("slot", "src", (F.col("before") + F.col("in_chunk")).alias("k"))
    )
    need = F.ceil(F.col("want") / block)
    want = aims.select("src", F.floor("target").alias("want"))
    found = counts.groupBy("src").agg(F.sum("n").alias("found"))
    late = (
        want.join(found, "src", "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .where(F.col("found") < need)
        .select("src", F.explode(F.sequence(F.col("found"), need - 1)).alias("k"))
        .select((F.lit(n_slots - 1) + F.row_number().over(Window.orderBy("k", "src"))).cast("long").alias("slot"), "src", "k")
    )
    took = ranked.unionByName(late).join(want, "src").withColumn("from", F.col("k") * block)
    return took.where("from < want").select("slot", "src", "k", "from", F.least(F.col("from") + block, F.col("want")).alias("to"))


def streams(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``, the document's first word in its source's shuffled stream, and (bucket, nth), its place."""
    n = sizes.count()
    buckets = 1 << max(0, (n // max(BUCKET, n // MOST_LEVEL)).bit_length())
    order = sizes.withColumn("bucket", F.floor(F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    inside = Window.partitionBy("src", "bucket").orderBy("mixed", "doc_id", "size")
    local = order.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = order.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return local.join(sums.select("src", "bucket", before.alias("before")), ["src", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("mixed", "before", "upto")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). Documents: doc_id, source, size, source_size, target, taken, first_slot, n_pieces. Pieces: what each slot takes of a document."""
    sizes = written(sized(docs), "sizes")
    aims = written(targets(sizes, weights, share, most), "targets")
    placed = written(streams(sizes).join(aims.select("src", "source_size", "target"), "src"), "streams")
    turns = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("begin", F.col("start") + F.col("turn") * F.col("source_size"))
    turns = turns.where((F.col("size") > 0) & (F.col("begin") < F.col("target")))
    spread = turns.withColumn("k", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    met = spread.join(schedule(aims, block), ["src", "k"])
    a, b = F.greatest("from", "begin"), F.least(F.col("to"), F.col("begin") + F.col("size"))
    pieces = met.where(b > a).select("src", "bucket", "nth", "doc_id", "content", "size", "turn", "slot", (a - F.col("begin")).alias("first"), (b - F.col("begin")).alias("last"))
    of_doc = pieces.groupBy("src", "bucket", "nth").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_pieces"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = placed.join(of_doc, ["src", "bucket", "nth"], "left").select("doc_id", "source", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_pieces"))
    return rows, pieces


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken, ``text`` cut to the words taken where it is not whole.

    The words of a cut text are joined by one space; ``n_chars``, if there, is the length of the text. Each partition is in the order of the slots.
    """
    _, pieces = mix(docs, **settings)
    key = ["anonymous", "id", "src", "content"]
    of_id = [F.col("doc_id").isNull().alias("anonymous"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id")]
    turns = pieces.groupBy("src", "bucket", "nth", "turn").agg(F.first("doc_id").alias("doc_id"), F.first("content").alias("content"), F.first("size").alias("size"), F.min("first").alias("a"), F.max("last").alias("b"), F.min("slot").alias("slot"))
    takings = turns.groupBy(*of_id, "src", "content", "size", "a", "b").agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot"))
    own = docs.select(whole(docs).alias("row"), *of_id, named(F.col("source")).alias("src"), row_hash(docs).alias("content"))
    once = own.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("src"))).where("nth = 1").drop("nth")
    met = once.join(takings, key).withColumn("taking", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    text = F.col("row").getField("text")
    part = F.slice(word_array(text), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    cut = met.select("row", "slot", F.when((F.col("a") == 0) & (F.col("b") == F.col("size")), text).otherwise(F.array_join(part, " ")).alias("taken"))
    new = {"text": F.col("taken").alias("text"), "n_chars": F.length("taken").cast("long").alias("n_chars")}
    return cut.sortWithinPartitions("slot").select(*[new.get(c, x) for c, x in zip(docs.columns, unpacked(F.col("row"), docs.columns), strict=True)])


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed to 150 % of its words."""
    rows, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS mixed
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS DOUBLE) AS weight FROM s),
r AS (
  SELECT *, {MOST} * source_size / weight AS ratio,
    sum({MOST} * source_size) OVER o AS capped, sum(weight) OVER () - sum(weight) OVER o AS free
  FROM w WINDOW o AS (ORDER BY {MOST} * source_size / weight, src ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT ratio, {SHARE} * (SELECT sum(source_size) FROM s) AS total, coalesce(lag(capped) OVER q, 0) AS c, coalesce(lag(free) OVER q, (SELECT sum(weight) FROM w)) AS f
  FROM r WINDOW q AS (ORDER BY ratio, src)),
level AS (SELECT coalesce((SELECT (total - c) / f FROM levels WHERE (total - c) / f < ratio ORDER BY ratio LIMIT 1), 1e300) AS v),
t AS (SELECT src, source_size, CASE WHEN ratio <= v THEN CAST({MOST} * source_size AS DOUBLE) ELSE weight * v END AS target FROM r, level),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY src ORDER BY mixed, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start, CAST(floor(target) AS BIGINT) AS want
  FROM d JOIN t USING (src)),
totals AS (SELECT sum(target) AS total, CAST(floor(sum(target) / {BLOCK}) AS BIGINT) + 1 AS n_slots FROM t),
upto AS (SELECT src, target, sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) / total AS hi FROM t, totals WHERE total > 0),
cuts AS (
  SELECT src, target, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo, CASE WHEN lead(src) OVER (ORDER BY src) IS NULL THEN 2 ELSE hi END AS hi FROM upto),
points AS (
  SELECT slot, (slot + 0.5::DOUBLE) * {PHI}::DOUBLE - floor((slot + 0.5::DOUBLE) * {PHI}::DOUBLE) AS u
  FROM (SELECT unnest(range((SELECT n_slots FROM totals))) AS slot)),
drawn AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS k FROM points JOIN cuts ON u >= lo AND u < hi WHERE target > 0),
late AS (
  SELECT src, unnest(range(coalesce(n, 0), CAST(ceil(floor(target) / {BLOCK}) AS BIGINT))) AS k
  FROM t LEFT JOIN (SELECT src, count(*) AS n FROM drawn GROUP BY src) USING (src)),
slots AS (SELECT slot, src, k FROM drawn UNION ALL SELECT n_slots - 1 + row_number() OVER (ORDER BY k, src), src, k FROM late, totals),
turns AS (
  SELECT *, greatest(0, least(size, want - start)) AS one, greatest(0, least(size, want - source_size - start)) AS two FROM placed)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken, slot AS first_slot,
  CAST(CASE WHEN one > 0 THEN (start + one - 1) // {BLOCK} - start // {BLOCK} + 1 ELSE 0 END
    + CASE WHEN two > 0 THEN (start + source_size + two - 1) // {BLOCK} - (start + source_size) // {BLOCK} + 1 ELSE 0 END AS BIGINT) AS n_pieces
FROM turns LEFT JOIN slots ON slots.src = turns.src AND slots.k = start // {BLOCK} AND one > 0
"""
