"""The engine's registered queries, and DuckDB SQL for those that SQL can express.

Each query runs over its whole tables. ``events`` is the ordered stream (event_id numbers it from 0),
``embeddings`` the vector set, ``documents`` and ``labels`` the labelled rows. Eight nodes, ten percent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary import config
from granary.functions import expr as X
from granary.operators import evaluate, features, fleet, gossip, prep, retention, rounds, stateful, vectors
from granary.sources import tables
from granary.sources.tables import dataset_key, percent_even, percent_of, table
from granary.streaming import stream

NODES, RATIO, FIT_ROWS, EPOCH = 8, 0.1, 20_000, 50
RATIOS = (0.01, 0.05, 0.1, 0.2, 0.5)
REPS, DIM = 6, 64
REPS_BYTES = vectors.bytes_of(NODES, REPS, DIM)
FANOUT = config.overlay_sizes(NODES)[1]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stream_items(s: SparkSession, d: str) -> DataFrame:
    """events as items: seq, key, node, epoch, payload."""
    e = features.with_seq(table(s, d, "events"), "event_id")
    return e.select(
        "seq", X.key_of(F.col("event_id"), F.col("seq")).alias("key"), X.owner(F.col("seq"), NODES).alias("node"), F.floor(F.col("seq") / EPOCH).alias("epoch"),
        X.payload_bytes(F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("props")).alias("payload"), "event_type", "value",
    )


ITEMS = f"""items AS (
  SELECT event_id AS seq, event_id AS key, CAST(event_id % {NODES} AS INTEGER) AS node, event_id // {EPOCH} AS epoch,
    CAST(24 + strlen(CAST(event_id AS VARCHAR)) + strlen(CAST(user_id AS VARCHAR)) + strlen(coalesce(event_type, '')) + strlen(coalesce(props, '')) AS BIGINT) AS payload,
    event_type, value FROM events)"""
BUDGET = f"greatest(1, CAST(ceil(count(*) * {RATIO}) AS BIGINT))"


def vector_items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("key"), X.owner(F.col("vec_id"), NODES).alias("node"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"), "label")


def scored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(items scored against their node's representatives, representatives)."""
    items = vector_items(s, d).select("key", "node", "vector")
    reps = vectors.representatives(items, REPS)
    return vectors.two_nearest(vectors.non_reps(items, reps, REPS_BYTES), reps, REPS_BYTES), reps


VECTORS = f"""v AS (
  SELECT vec_id AS key, CAST(vec_id % {NODES} AS INTEGER) AS node, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, row_number() OVER (PARTITION BY vec_id % {NODES} ORDER BY vec_id) AS r FROM embeddings),
reps AS (SELECT * FROM v WHERE r <= {REPS}),
near AS (
  SELECT v.key, v.node, v.r, p.key AS k, list_distance(v.v, p.v) AS d, row_number() OVER (PARTITION BY v.key ORDER BY list_distance(v.v, p.v), p.r) AS n
  FROM v JOIN reps p ON v.node = p.node AND v.key <> p.key),
two AS (SELECT key, node, r, max(k) FILTER (n = 1) AS k1, max(d) FILTER (n = 1) AS d1, max(k) FILTER (n = 2) AS k2, max(d) FILTER (n = 2) AS d2 FROM near WHERE n <= 2 GROUP BY ALL),
bins AS (SELECT node, k1, count(*) AS load, sum(d1) AS sum_distance, avg(d1) AS mean_distance FROM two WHERE r > {REPS} GROUP BY ALL),
active AS (SELECT node, count(*) AS bins FROM bins GROUP BY ALL)"""


def utility_sql(capacity: str) -> str:
    return f"""scored AS (
  SELECT key, node, d1 / greatest(1e-9, mean_distance) * greatest(0.5, least(2.0, (greatest(1.0, greatest({capacity} - {REPS}, 0) / CAST(bins AS DOUBLE)) + 1) / (load + 1))) AS utility
  FROM two JOIN bins USING (node, k1) JOIN active USING (node) WHERE r > {REPS})"""


CAPACITY = "(SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM embeddings)"


def capacity_of(s: SparkSession, d: str) -> int:
    return config.budget(table(s, d, "embeddings").count(), RATIO)


# scans and sizes


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(s, d):
    return table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT event_id, value FROM events WHERE event_id < {FIT_ROWS}")
def fit_sample(s, d):
    return features.with_seq(table(s, d, "events").select("event_id", "value"), "event_id").where(F.col("seq") < FIT_ROWS).select("event_id", "value")


@query(
    "SELECT ratio, b AS budget, CAST(greatest(1, least(floor(sqrt(b)), greatest(1, b - 1))) AS BIGINT) AS max_reps, CAST(floor(ratio * 100 + 0.5) AS INTEGER) AS ratio_int FROM ("
    f"SELECT ratio, greatest(1, CAST(ceil(n * ratio) AS BIGINT)) AS b FROM (SELECT count(*) AS n FROM events), (SELECT CAST(unnest([{', '.join(map(str, RATIOS))}]) AS DOUBLE) AS ratio))"
)
def budget_by_ratio(s, d):
    n = table(s, d, "events").agg(F.count(F.lit(1)).alias("n"))
    b = n.select("n", F.explode(F.array(*map(F.lit, RATIOS))).alias("ratio")).withColumn("budget", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("ratio"))))
    reps = F.greatest(F.lit(1), F.least(F.floor(F.sqrt("budget")), F.greatest(F.lit(1), F.col("budget") - 1)))
    return b.select("ratio", "budget", reps.cast("long").alias("max_reps"), percent_of(F.col("ratio")).alias("ratio_int"))


@query("""SELECT n AS nodes, CAST(least(most, greatest(4, ceil(sqrt(n) * l))) AS INTEGER) AS view_size, CAST(least(most, greatest(2, ceil(sqrt(n) * sqrt(l)))) AS INTEGER) AS fanout
FROM (SELECT n, greatest(1, n - 1) AS most, CASE WHEN n <= 1 THEN 1 ELSE (SELECT min(b) FROM range(1, 8) t(b) WHERE (1 << b) >= n) END AS l FROM (SELECT CAST(range AS INTEGER) AS n FROM range(1, 37)))""")
def overlay_params(s, d):
    return s.createDataFrame([(n, *config.overlay_sizes(n)) for n in range(1, 37)], "nodes int, view_size int, fanout int")


@query("""SELECT DISTINCT event_type, event_type || '_train.csv' AS path, lower(event_type) AS dataset FROM events""")
def dataset_keys(s, d):
    path = F.concat("event_type", F.lit("_train.csv"))
    return table(s, d, "events").select("event_type", path.alias("path"), dataset_key(path).alias("dataset")).distinct()


# features


def fitted(column_query, log):
    x = "sign(x) * ln(1 + abs(x))" if log else "x"
    return f"""WITH long AS ({column_query}), v AS (SELECT "column", {x} AS x FROM long)
SELECT "column", round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS std, round(quantile_cont(x, 0.5), 6) AS median,
  round(CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END, 6) AS iqr FROM v GROUP BY "column" """


PART = "SELECT 'p_size' AS \"column\", CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part"


def stats_of(s, d, log):
    f = features.fit(table(s, d, "part"), ["p_size", "p_retailprice"], log)
    return f.select("column", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "iqr")])


@query(fitted(PART, False))
def fit_stats(s, d):
    return stats_of(s, d, False)


@query(fitted(PART, True))
def fit_log_stats(s, d):
    return stats_of(s, d, True)


def add_vector_query(transform: str) -> None:
    log, robust = transform.startswith("log_"), transform.endswith("robust")
    columns = ["c_nationkey", "c_acctbal"]

    def run(s, d):
        df = features.with_seq(table(s, d, "customer"), "c_custkey")
        stats = features.fit_row(df.where(F.col("seq") < FIT_ROWS), columns, log)
        return df.select("c_custkey", *[F.round(F.get(features.vector(columns, stats, transform), F.lit(k)).cast("double"), 4).alias(f"v{k}") for k in range(2)])

    x = {c: f"(sign(CAST({c} AS DOUBLE)) * ln(1 + abs(CAST({c} AS DOUBLE))))" if log else f"CAST({c} AS DOUBLE)" for c in columns}
    center = lambda c: f"quantile_cont({x[c]}, 0.5)" if robust else f"avg({x[c]})"
    width = lambda c: f"quantile_cont({x[c]}, 0.75) - quantile_cont({x[c]}, 0.25)" if robust else f"stddev_pop({x[c]})"
    cells = ", ".join(f"round(CAST(CAST(({x[c]} - m{k}) / CASE WHEN s{k} > 0 THEN s{k} ELSE 1 END AS FLOAT) AS DOUBLE), 4) AS v{k}" for k, c in enumerate(columns))
    stats = ", ".join(f"{center(c)} AS m{k}, {width(c)} AS s{k}" for k, c in enumerate(columns))
    QUERIES[f"vec_{transform}"] = run
    SQL[f"vec_{transform}"] = f"WITH f AS (SELECT {stats} FROM customer WHERE c_custkey < {FIT_ROWS}) SELECT c_custkey, {cells} FROM customer, f"


for _t in config.TRANSFORMS:
    add_vector_query(_t)


@query("SELECT doc_id, coalesce(TRY_CAST(trim(replace(source, 'src', '')) AS DOUBLE), 0.0) AS from_source, coalesce(TRY_CAST(trim(lang) AS DOUBLE), 0.0) AS from_lang FROM documents")
def safe_parse(s, d):
    return table(s, d, "documents").select("doc_id", X.safe_double(F.replace("source", F.lit("src"), F.lit(""))).alias("from_source"), X.safe_double(F.col("lang")).alias("from_lang"))


# owners, epochs, versions


@query(f"WITH {ITEMS} SELECT node, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM items GROUP BY node")
def round_robin_owner(s, d):
    return stream_items(s, d).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(f"WITH {ITEMS} SELECT epoch, max(seq) AS trigger_seq, count(*) AS n FROM items GROUP BY epoch HAVING (max(seq) + 1) % {EPOCH} = 0")
def epoch_trigger(s, d):
    return stream_items(s, d).groupBy("epoch").agg(F.max("seq").alias("trigger_seq"), F.count(F.lit(1)).alias("n")).where((F.col("trigger_seq") + 1) % EPOCH == 0)


@query(f"WITH {ITEMS} SELECT key, (CAST(node AS BIGINT) << 48) | (seq // {NODES} + 1) AS version FROM items")
def version_ids(s, d):
    # under full retention a node's counter is its rows so far, which round-robin ownership gives without a window
    return stream_items(s, d).select("key", X.version_id(F.col("node"), F.floor(F.col("seq") / NODES) + 1).alias("version"))


@query("SELECT doc_id, coalesce(TRY_CAST(trim(replace(source, 'src1', '')) AS BIGINT), doc_id) AS key FROM documents")
def derive_key(s, d):
    return table(s, d, "documents").select("doc_id", X.key_of(F.replace("source", F.lit("src1"), F.lit("")), F.col("doc_id")).alias("key"))


# vectors


@query(f"WITH {VECTORS} SELECT key, node, k1, round(d1, 6) AS d1, k2, round(d2, 6) AS d2 FROM two WHERE r > {REPS}")
def two_nearest_reps(s, d):
    return scored(s, d)[0].select("key", "node", "k1", F.round("d1", 6).alias("d1"), "k2", F.round("d2", 6).alias("d2"))


@query(f"WITH {VECTORS}, ex AS (SELECT key, k, d, row_number() OVER (PARTITION BY key ORDER BY n) AS m FROM near WHERE r > {REPS} AND k >= {NODES}) SELECT key, k AS k1, round(d, 6) AS d1 FROM ex WHERE m = 1")
def nearest_excluding(s, d):
    items = vector_items(s, d).select("key", "node", "vector")
    reps = vectors.representatives(items, REPS)
    return vectors.two_nearest(vectors.non_reps(items, reps, REPS_BYTES), reps.where(F.col("rep_rank") > 1), REPS_BYTES).select("key", "k1", F.round("d1", 6).alias("d1"))


REP_UTILITY = "round(ln(1 + d1) * (1 + 0.25 * least(1.0, d1 / d2)), 6)"


@query(f"WITH {VECTORS} SELECT node, key, {REP_UTILITY} AS utility FROM two WHERE r <= {REPS}")
def rep_utilities(s, d):
    return vectors.rep_utilities(scored(s, d)[1]).select("node", "key", F.round("utility", 6).alias("utility"))


@query(f"WITH {VECTORS} SELECT node, min({REP_UTILITY}) AS least, round(avg({REP_UTILITY}), 5) AS mean FROM two WHERE r <= {REPS} GROUP BY node")
def rep_min_mean(s, d):
    u = X.finite(F.round("utility", 6))
    return vectors.rep_utilities(scored(s, d)[1]).groupBy("node").agg(F.coalesce(F.min(u), F.lit(0.0)).alias("least"), F.round(F.coalesce(F.avg(u), F.lit(0.0)), 5).alias("mean"))


@query(f"WITH {VECTORS} SELECT node, k1, load, round(sum_distance, 6) AS sum_distance, round(mean_distance, 6) AS mean_distance FROM bins")
def bin_stats(s, d):
    return vectors.bins(scored(s, d)[0]).select("node", "k1", "load", F.round("sum_distance", 6).alias("sum_distance"), F.round("mean_distance", 6).alias("mean_distance"))


def with_utility(s, d):
    near, _ = scored(s, d)
    return vectors.utilities(near, vectors.bins(near), capacity_of(s, d), REPS, size=REPS_BYTES)


@query(f"WITH {VECTORS}, {utility_sql(CAPACITY)} SELECT key, node, round(utility, 6) AS utility FROM scored")
def store_utility(s, d):
    return with_utility(s, d).select("key", "node", F.round("utility", 6).alias("utility"))


@query(f"WITH {VECTORS}, {utility_sql(CAPACITY)}, x AS (SELECT node, key, row_number() OVER (PARTITION BY node ORDER BY utility DESC, key) AS rank FROM scored) SELECT * FROM x WHERE rank <= {CAPACITY} - {REPS}")
def retain_utility_batch(s, d):
    return vectors.keep_best(with_utility(s, d), max(0, capacity_of(s, d) - REPS)).select("node", "key", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VECTORS}, {utility_sql(CAPACITY)} SELECT node, arg_min(key, (utility, key)) AS worst_key, round(min(utility), 6) AS utility FROM scored GROUP BY node")
def evict_worst(s, d):
    u = F.struct("utility", "key")
    return with_utility(s, d).groupBy("node").agg(F.min_by("key", u).alias("worst_key"), F.round(F.min("utility"), 6).alias("utility"))


# retention


@query(f"WITH {ITEMS} SELECT node, count(*) AS stored, CAST(sum(payload) AS BIGINT) AS bytes FROM items GROUP BY node")
def retain_full(s, d):
    return stream_items(s, d).groupBy("node").agg(F.count(F.lit(1)).alias("stored"), F.sum("payload").alias("bytes"))


RANKED = f"""{ITEMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('{retention.SEED}|' || node || '|' || key), key) AS place FROM items)"""


@query(f"WITH {RANKED} SELECT node, count(*) AS stored, CAST(sum(payload) AS BIGINT) AS bytes, min(key) AS first_key, max(key) AS last_key FROM ranked WHERE place <= (SELECT {BUDGET} FROM events) GROUP BY node")
def retain_random(s, d):
    items = stream_items(s, d)
    kept = retention.uniform(items, config.budget(table(s, d, "events").count(), RATIO))
    return kept.groupBy("node").agg(F.count(F.lit(1)).alias("stored"), F.sum("payload").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(
    f"WITH {RANKED}, b AS (SELECT ratio, greatest(1, CAST(ceil((SELECT count(*) FROM events) * ratio) AS BIGINT)) AS budget FROM (SELECT CAST(unnest([{', '.join(map(str, RATIOS))}]) AS DOUBLE) AS ratio)) "
    "SELECT ratio, node, count(*) AS stored, CAST(sum(payload) AS BIGINT) AS bytes FROM ranked JOIN b ON place <= budget GROUP BY ALL"
)
def ratio_sweep(s, d):
    # one ranking serves all ratios: smaller budgets are prefixes
    n = table(s, d, "events").count()
    sums = [a for r in RATIOS for k in [config.budget(n, r)] for a in (F.count(F.when(F.col("place") <= k, 1)).alias(f"n{r}"), F.sum(F.when(F.col("place") <= k, F.col("payload"))).alias(f"b{r}"))]
    wide = retention.ranked(stream_items(s, d)).groupBy("node").agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(f"`n{r}`").alias("stored"), F.col(f"`b{r}`").alias("bytes")) for r in RATIOS]))
    return wide.select("node", rows.alias("x")).select("x.ratio", "node", "x.stored", "x.bytes")


def utility_events(s, d):
    return stateful.retain_in_order(vector_items(s, d), "utility", capacity_of(s, d), config.max_representatives(capacity_of(s, d)))


@query()
def retain_utility_seq(s, d):
    return stateful.stored(utility_events(s, d))


@query()
def utility_reports(s, d):
    """Every 25 offers of a node: decisions, utilities, and the state at the window's end."""
    room = capacity_of(s, d)
    return stateful.window_reports(stateful.retain_in_order(vector_items(s, d), "utility", room, config.max_representatives(room), NODES, every=25), 25)


@query()
def retain_reservoir_seq(s, d):
    return stateful.stored(stateful.retain_in_order(vector_items(s, d), "random", capacity_of(s, d) // NODES + 1))


@query()
def decision_counters(s, d):
    kind = lambda *k: F.count(F.when(F.col("kind").isin(*k), 1))
    return utility_events(s, d).groupBy("node").agg(
        F.count(F.lit(1)).alias("seen"), kind("ADMITTED", "EVICTED_AND_ADMITTED").alias("admitted"), kind("DROPPED").alias("dropped"), kind("EVICTED_AND_ADMITTED").alias("evicted"),
        F.count(F.when(F.col("drop_cause") == "DUPLICATE", 1)).alias("dropped_duplicate"), F.count(F.when(F.col("drop_cause") == "UTILITY", 1)).alias("dropped_utility"),
    )


# gossip


def peers_sql(epochs: str) -> str:
    return f"""peers AS (SELECT epoch, src, dst FROM (
  SELECT epoch, src, dst, row_number() OVER (PARTITION BY epoch, src ORDER BY md5(epoch || '|' || src || '|' || dst), dst) AS r
  FROM (SELECT CAST(range AS INTEGER) AS src FROM range({NODES})), (SELECT CAST(range AS INTEGER) AS dst FROM range({NODES})), (SELECT CAST(range AS INTEGER) AS epoch FROM range({epochs})) WHERE src <> dst) WHERE r <= {FANOUT})"""


DRAWS = 16


@query(f"WITH {peers_sql(str(DRAWS))} SELECT * FROM peers")
def peer_sample(s, d):
    return gossip.peers(s, NODES, FANOUT, DRAWS)


@query(f"WITH e AS (SELECT CAST(a.range AS INTEGER) AS src, CAST(b.range AS INTEGER) AS dst FROM range({NODES}) a, range({NODES}) b WHERE a.range <> b.range) SELECT src, arg_max(dst, ((src * 7 + dst * 3) % 5, -dst)) AS oldest FROM e GROUP BY src")
def oldest_peer(s, d):
    aged = gossip.pairs(s, NODES).withColumn("age", (F.col("src") * 7 + F.col("dst") * 3) % 5)
    return aged.groupBy("src").agg(F.max_by("dst", F.struct("age", (-F.col("dst")).alias("m"))).alias("oldest"))


@query(
    f"WITH e AS (SELECT CAST(a.range AS INTEGER) AS src, CAST(b.range AS INTEGER) AS dst, CAST(c.range AS INTEGER) AS side FROM range({NODES}) a, range({NODES}) b, range(2) c WHERE a.range <> b.range), "
    "m AS (SELECT src, dst, min((src * 7 + dst * 3 + side * 4) % 9) AS age FROM e GROUP BY ALL) SELECT src, dst, age FROM m QUALIFY row_number() OVER (PARTITION BY src ORDER BY age DESC, dst) <= 4"
)
def view_merge(s, d):
    aged = gossip.pairs(s, NODES)
    both = [aged.withColumn("age", (F.col("src") * 7 + F.col("dst") * 3 + side * 4) % 9) for side in (0, 1)]
    merged = both[0].unionByName(both[1]).groupBy("src", "dst").agg(F.min("age").alias("age"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("age"), "dst"))
    return merged.withColumn("r", rank).where("r <= 4").select("src", "dst", "age")


VIEW = 4


@query(f"""WITH v AS (SELECT CAST(a.range AS INTEGER) AS src, CAST(b.range AS INTEGER) AS dst, CAST((a.range * 7 + b.range * 3) % 5 + 1 AS INTEGER) AS age FROM range({NODES}) a, range({NODES}) b WHERE a.range <> b.range AND (a.range + b.range) % 2 = 1),
p AS (SELECT src, arg_max(dst, (age, -dst)) AS partner FROM v GROUP BY src),
e AS (SELECT src AS t, dst, age FROM v UNION ALL SELECT partner, src, 0 FROM p UNION ALL SELECT partner, dst, age FROM v JOIN p USING (src) UNION ALL SELECT p.src, v.dst, v.age FROM p JOIN v ON v.src = p.partner),
m AS (SELECT t AS src, dst, min(age) AS age FROM e WHERE t <> dst GROUP BY ALL)
SELECT src, dst, age FROM m QUALIFY row_number() OVER (PARTITION BY src ORDER BY age DESC, dst) <= {VIEW}""")
def overlay_cycle(s, d):
    view = gossip.pairs(s, NODES).where((F.col("src") + F.col("dst")) % 2 == 1).withColumn("age", ((F.col("src") * 7 + F.col("dst") * 3) % 5).cast("int"))
    return gossip.cycle(view, VIEW)


@query(f"""WITH i AS (SELECT CAST(user_id % {NODES} AS INTEGER) AS node, event_id % 500 AS key, event_id AS version FROM events),
st AS (SELECT node, key, min(version) + 1000 AS version FROM i GROUP BY ALL) SELECT i.* FROM i LEFT JOIN st USING (node, key) WHERE st.version IS NULL OR st.version < i.version""")
def gossip_newer(s, d):
    arrived = table(s, d, "events").select(X.owner(F.col("user_id"), NODES).alias("node"), (F.col("event_id") % 500).alias("key"), F.col("event_id").alias("version"))
    return gossip.newer(arrived, arrived.groupBy("node", "key").agg((F.min("version") + 1000).alias("version")))


@query(f"WITH {ITEMS} SELECT node, epoch, key FROM items QUALIFY row_number() OVER (PARTITION BY node, epoch ORDER BY seq) <= 4")
def fifo_batch(s, d):
    rank = F.row_number().over(Window.partitionBy("node", "epoch").orderBy("seq"))
    return stream_items(s, d).withColumn("r", rank).where("r <= 4").select("node", "epoch", "key")


@query(f"WITH {ITEMS} SELECT node, key FROM items QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC) <= 100")
def queue_cap(s, d):
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("seq")))
    return stream_items(s, d).withColumn("r", rank).where("r <= 100").select("node", "key")


def spread_of(s, d, ttl=2):
    items = stream_items(s, d)
    drawn = gossip.peers(s, NODES, FANOUT, DRAWS)
    return gossip.spread(items.withColumn("epoch", (F.col("epoch") % DRAWS).cast("int")), drawn, ttl)


SPREAD = f"""{ITEMS}, {peers_sql(str(DRAWS))},
owned AS (SELECT node AS src, key, CAST(epoch % {DRAWS} AS INTEGER) AS epoch, payload FROM items),
hop1 AS (SELECT src, dst, key, epoch, payload FROM owned JOIN peers USING (epoch, src)),
new1 AS (SELECT dst AS src, key, epoch, payload FROM hop1),
hop2 AS (SELECT src, dst, key, epoch, payload FROM new1 JOIN peers USING (epoch, src)),
sent AS (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2),
held AS (SELECT src AS node, key FROM owned UNION SELECT dst, key FROM sent)"""


@query(f"WITH {SPREAD} SELECT src, dst, count(*) AS n, CAST(sum(payload) AS BIGINT) AS bytes FROM hop1 GROUP BY ALL")
def gossip_hop1(s, d):
    return spread_of(s, d, 1)[0].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("payload").alias("bytes"))


@query(f"WITH {SPREAD} SELECT src, dst, count(*) AS n, CAST(sum(payload) AS BIGINT) AS bytes FROM sent GROUP BY ALL")
def gossip_hop2(s, d):
    return spread_of(s, d)[0].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("payload").alias("bytes"))


@query(f"WITH {SPREAD} SELECT node, count(*) AS held FROM held GROUP BY node")
def gossip_dedup(s, d):
    return spread_of(s, d)[1].groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("held"))


@query(f"WITH {SPREAD} SELECT CAST(sum(payload) AS BIGINT) AS total_bytes_sent, count(*) AS copies FROM sent")
def bytes_sent(s, d):
    return spread_of(s, d)[0].agg(F.sum("payload").alias("total_bytes_sent"), F.count(F.lit(1)).alias("copies"))


def coverage_of(s, d):
    return spread_of(s, d)[1].groupBy("key").agg(F.countDistinct("dst").alias("coverage"))


@query(f"WITH {SPREAD} SELECT key, count(*) AS coverage FROM held GROUP BY key")
def coverage(s, d):
    return coverage_of(s, d)


@query(f"WITH {SPREAD} SELECT coverage, count(*) AS n FROM (SELECT key, count(*) AS coverage FROM held GROUP BY key) GROUP BY coverage")
def coverage_hist(s, d):
    return coverage_of(s, d).groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPREAD} SELECT round(avg(coverage) / {NODES} * 100, 6) AS coverage_pct FROM (SELECT key, count(*) AS coverage FROM held GROUP BY key)")
def coverage_pct(s, d):
    return coverage_of(s, d).agg(F.round(F.avg("coverage") / NODES * 100, 6).alias("coverage_pct"))


ROUNDS = 4


def rounds_of(s, d):
    """Nodes keep by utility; what they admit goes two hops, and the peers decide about it."""
    items = vector_items(s, d).withColumn("payload", X.payload_bytes(F.col("key"), F.col("label")))
    room = capacity_of(s, d)
    return rounds.simulate(items, "utility", room, config.max_representatives(room), NODES, FANOUT, F.floor(F.col("seq") / NODES) % ROUNDS, ROUNDS)


@query()
def gossip_bounded(s, d):
    return stateful.stored(rounds_of(s, d)[0])


@query()
def gossip_counters(s, d):
    """What became of own rows and arrived copies at each node, and the bytes that it sent."""
    events, sent = rounds_of(s, d)
    bytes_out = sent.groupBy(F.col("src").alias("node")).agg(F.sum("payload").alias("bytes_sent"))
    return rounds.counters(events).join(bytes_out, "node", "left").fillna(0, ["bytes_sent"])


# the fleet row by row

CREW = 4


def whole_fleet(s, d):
    """Nodes that may keep everything and know all others: what happens does not depend on any draw."""
    items = stream_items(s, d).withColumn("node", X.owner(F.col("seq"), CREW)).withColumn("vector", F.array(F.coalesce("value", F.lit(0.0)).cast("float")))
    others = CREW - 1
    return fleet.simulate(items, [("random", table(s, d, "events").count(), 1)], fleet.Fleet(CREW, others, others, others))


@query(f"""WITH {ITEMS}, own AS (SELECT CAST(seq % {CREW} AS INTEGER) AS node, count(*) AS own FROM items GROUP BY ALL), whole AS (SELECT count(*) AS n, CAST(sum(payload) AS BIGINT) AS bytes FROM items)
SELECT node, own + {CREW - 1} * n AS seen, n AS admitted, own + {CREW - 2} * n AS dropped, CAST(0 AS BIGINT) AS evicted, n AS stored, CAST(0 AS BIGINT) AS queue, CAST(0 AS BIGINT) AS lost, {CREW - 1} * bytes AS bytes_sent FROM own, whole""")
def fleet_totals(s, d):
    """The owner sends each row to all others; each of them sends it on to all others, which hold it."""
    return fleet.finals(whole_fleet(s, d)).select("node", "seen", "admitted", "dropped", "evicted", "stored", "queue", "lost", "bytes_sent")


@query(f"WITH {ITEMS} SELECT CAST(range AS INTEGER) AS node, key FROM items, range({CREW})")
def fleet_stored(s, d):
    return fleet.stored(whole_fleet(s, d)).select("node", "key")


def fleet_runs(s, d):
    """Both bounded modes at two ratios, gossiping among eight nodes with derived views."""
    items = vector_items(s, d).withColumn("payload", X.payload_bytes(F.col("key"), F.col("label")))
    n, (view, fanout) = table(s, d, "embeddings").count(), config.overlay_sizes(NODES)
    runs = [(mode, room, config.max_representatives(room)) for mode in ("random", "utility") for r in (0.05, RATIO) for room in [config.budget(n, r)]]
    return fleet.simulate(items, runs, fleet.Fleet(NODES, fanout, view, view, every=100))


@query()
def fleet_finals(s, d):
    return fleet.finals(fleet_runs(s, d))


@query()
def fleet_progress(s, d):
    """Stored rows, queue lengths, utility and bytes sent after every hundred rows."""
    return fleet.progress(fleet_runs(s, d))


# metrics


@query(f"WITH {ITEMS} SELECT seq // 1000 AS window_no, node, count(*) AS seen, round(avg(value), 5) AS mean_value FROM items GROUP BY ALL")
def window_report(s, d):
    return stream_items(s, d).groupBy(F.floor(F.col("seq") / 1000).alias("window_no"), "node").agg(F.count(F.lit(1)).alias("seen"), F.round(F.avg(X.finite(F.col("value"))), 5).alias("mean_value"))


@query(f"SELECT CAST(vec_id % {NODES} AS INTEGER) AS node, count(*) * (24 + 8 * CAST(max(len(embedding)) AS BIGINT)) AS stored_bytes FROM embeddings GROUP BY vec_id % {NODES}")
def stored_bytes(s, d):
    return vector_items(s, d).groupBy("node").agg((F.count(F.lit(1)) * (24 + 8 * F.max(F.size("vector")))).cast("long").alias("stored_bytes"))


@query(f"WITH {ITEMS} SELECT coalesce(node, -1) AS node, count(*) AS seen, CAST(sum(payload) AS BIGINT) AS bytes FROM items GROUP BY ROLLUP (node)")
def node_totals(s, d):
    # -1: all nodes
    return stream_items(s, d).rollup("node").agg(F.count(F.lit(1)).alias("seen"), F.sum("payload").alias("bytes")).fillna(-1, ["node"])


@query(f"SELECT CAST(vec_id % {NODES} AS INTEGER) AS node, label, count(*) AS n FROM embeddings GROUP BY ALL")
def node_class_stats(s, d):
    return vector_items(s, d).groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(doc_id % {NODES} AS INTEGER) AS node, CAST(sum(toxic) AS BIGINT) AS pos, CAST(count(*) - sum(toxic) AS BIGINT) AS neg, round(avg(toxic), 6) AS pos_ratio FROM labels GROUP BY doc_id % {NODES}")
def node_binary_stats(s, d):
    return table(s, d, "labels").groupBy(X.owner(F.col("doc_id"), NODES).alias("node")).agg(F.sum("toxic").alias("pos"), (F.count(F.lit(1)) - F.sum("toxic")).alias("neg"), F.round(F.avg("toxic"), 6).alias("pos_ratio"))


@query(f"WITH {VECTORS}, {utility_sql(CAPACITY)} SELECT node, round(sum(utility) / (count(*) * (24 + 8 * 64)), 6) AS density FROM scored GROUP BY node")
def utility_density(s, d):
    u = X.finite(F.col("utility"))
    return with_utility(s, d).groupBy("node").agg(F.round(F.sum(u) / (F.count(F.lit(1)) * (24 + 8 * F.max(F.size("vector")))), 6).alias("density"))


@query(
    f"WITH {RANKED}, b AS (SELECT ratio, greatest(1, CAST(ceil((SELECT count(*) FROM events) * ratio) AS BIGINT)) AS budget FROM (SELECT CAST(unnest([{', '.join(map(str, RATIOS))}]) AS DOUBLE) AS ratio)) "
    "SELECT ratio, CAST(sum(payload) AS BIGINT) AS bytes, (SELECT CAST(sum(payload) AS BIGINT) FROM items) AS full_bytes FROM ranked JOIN b ON place <= budget GROUP BY ratio"
)
def byte_series(s, d):
    full = stream_items(s, d).agg(F.sum("payload").alias("full_bytes"))  # one row
    return ratio_sweep(s, d).groupBy("ratio").agg(F.sum("bytes").alias("bytes")).join(F.broadcast(full))


# preparation


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, 0.0 AS p_weight, p_retailprice FROM part")
def reindex_features(s, d):
    return prep.reindexed(table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey", "p_size", "p_weight", "p_retailprice"])


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def numeric_clean(s, d):
    bad = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return prep.numeric_only(table(s, d, "customer").withColumn("c_acctbal", bad))


@query("SELECT DISTINCT greatest(1, event_id % 400) / 400 AS ratio, CAST(floor(greatest(1, event_id % 400) / 400 * 100 + 0.5) AS INTEGER) AS half_up, CAST(round_even(greatest(1, event_id % 400) / 400 * 100, 0) AS INTEGER) AS half_even FROM events")
def ratio_percents(s, d):
    """Ratios in whole percent, halves up and halves to even; every other one is a half or a quarter."""
    ratio = F.greatest(F.lit(1), F.col("event_id") % 400) / 400
    return table(s, d, "events").select(ratio.alias("ratio"), percent_of(ratio).alias("half_up"), percent_even(ratio).alias("half_even")).distinct()


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 0 ORDER BY lang")
def category_values(s, d):
    return prep.category_counts(table(s, d, "documents"), "lang").select(F.col("value").alias("lang"), "n")


@query("SELECT doc_id AS __id, lang FROM documents")
def global_id(s, d):
    return prep.with_global_id(table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def class_balance(s, d):
    n = table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders")
def target_stats(s, d):
    x = "o_totalprice"
    return table(s, d, "orders").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("median"))


QUOTAS = """counts AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
exact AS (SELECT lang, n * 150 / CAST(sum(n) OVER () AS DOUBLE) AS x FROM counts),
quotas AS (
  SELECT lang, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) <= 150 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM exact)"""


@query(f"WITH {QUOTAS}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s|' || doc_id), doc_id) AS place FROM documents) SELECT doc_id, lang FROM r JOIN quotas USING (lang) WHERE place <= quota")
def stratified_sample(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang")
    return prep.stratified(docs, "doc_id", "lang", prep.quotas(docs, "lang", 150)).select("doc_id", "lang")


@query("SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY md5('s|' || doc_id), doc_id) <= CASE WHEN toxic = 1 THEN 6 ELSE 24 END")
def binary_sample(s, d):
    wanted = s.createDataFrame([(0, 24), (1, 6)], "toxic int, quota long")
    return prep.stratified(table(s, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id", "toxic", wanted).select("doc_id", "toxic")


@query("SELECT o_orderkey FROM orders ORDER BY md5('u|' || o_orderkey), o_orderkey LIMIT 1000")
def uniform_sample(s, d):
    return prep.uniform_rows(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


SPLIT = """tr AS (SELECT o_orderkey FROM orders ORDER BY md5('u|' || o_orderkey), o_orderkey LIMIT 800),
te AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tr) ORDER BY md5('t|' || o_orderkey), o_orderkey LIMIT 200)"""


def split_of(s, d):
    orders = table(s, d, "orders").select("o_orderkey")
    train = prep.uniform_rows(orders, "o_orderkey", 800)
    return train, prep.uniform_rows(orders.join(train, "o_orderkey", "left_anti"), "o_orderkey", 200, "t")


@query(f"WITH {SPLIT} SELECT o_orderkey, 'train' AS part FROM tr UNION ALL SELECT o_orderkey, 'test' FROM te")
def train_test_split(s, d):
    train, test = split_of(s, d)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(f"WITH {SPLIT} SELECT count(*) AS overlap FROM tr WHERE o_orderkey IN (SELECT o_orderkey FROM te)")
def split_overlap(s, d):
    train, test = split_of(s, d)
    return train.join(test, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


@query("SELECT event_id, CASE WHEN event_id < greatest(1, least(n - 1, CAST(round(n * 0.8) AS BIGINT))) THEN 'train' ELSE 'test' END AS part FROM events, (SELECT count(*) AS n FROM events)")
def drift_split(s, d):
    events = table(s, d, "events").select("event_id")
    n = events.count()
    cut = max(1, min(n - 1, round(n * 0.8)))
    return features.with_seq(events, "event_id").select("event_id", F.when(F.col("seq") < cut, "train").otherwise("test").alias("part"))


@query("""WITH tr AS (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderpriority <> '3-MEDIUM'), codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM tr)
SELECT o_orderkey, CAST(coalesce(code, -1) AS INTEGER) AS o_orderpriority FROM orders LEFT JOIN codes ON o_orderpriority = v""")
def label_encode(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    codes = prep.encoder(orders.where("o_orderkey % 5 <> 0 AND o_orderpriority <> '3-MEDIUM'"), "o_orderpriority")
    return prep.encode(orders, "o_orderpriority", codes).select("o_orderkey", "o_orderpriority")


# evaluation

PRED = "pred AS (SELECT label, CAST(vec_id % 7 % 10 AS INTEGER) AS predicted FROM embeddings)"


def predictions(s, d):
    return table(s, d, "embeddings").select("label", (F.col("vec_id") % 7 % 10).cast("int").alias("predicted"))


@query(f"""WITH {PRED}, t AS (SELECT label, count(*) AS n_true, count(*) FILTER (label = predicted) AS tp FROM pred GROUP BY label), p AS (SELECT predicted AS label, count(*) AS n_pred FROM pred GROUP BY predicted),
c AS (SELECT coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred FROM t FULL JOIN p USING (label))
SELECT round(avg(2.0 * tp / (n_true + n_pred)), 6) AS macro_f1, round(avg(tp / n_true) FILTER (n_true > 0), 6) AS balanced_accuracy FROM c""")
def accuracy(s, d):
    return evaluate.accuracy_scores(predictions(s, d))


@query("""WITH x AS (SELECT toxic AS label, quality * 3 + doc_id % 11 AS score FROM labels), st AS (SELECT score, sum(label) AS pos, count(*) AS n FROM x GROUP BY score),
r AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS seen, sum(pos) OVER () AS ap, sum(n) OVER () AS an FROM st WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(pos / ap * tp / seen), 6) AS average_precision, round(sum((n - pos) * (tp - pos + pos / 2.0)) / max(ap * (an - ap)), 6) AS roc_auc FROM r""")
def ranking(s, d):
    return evaluate.ranking_scores(table(s, d, "labels").select(F.col("toxic").alias("label"), (F.col("quality") * 3 + F.col("doc_id") % 11).alias("score")))


@query("SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 1 AND quality = 0) AS fn FROM labels")
def confusion(s, d):
    cell = lambda t, q: F.count(F.when((F.col("toxic") == t) & (F.col("quality") == q), 1))
    return table(s, d, "labels").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))


@query("SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY label")
def class_weights(s, d):
    n = table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return n.select("label", F.round(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), 6).alias("weight"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 3) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 3) AS std FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus")
def metric_mean_std(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)), 3).alias("std")).orderBy("o_orderstatus")


@query("SELECT round(a - 0.06 * (b - a), 5) AS low, round(b + 0.06 * (b - a), 5) AS high FROM (SELECT quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM events)")
def robust_limits(s, d):
    q = table(s, d, "events").agg(F.percentile("value", F.lit(0.005)).alias("a"), F.percentile("value", F.lit(0.995)).alias("b"))
    return q.select(F.round(F.col("a") - 0.06 * (F.col("b") - F.col("a")), 5).alias("low"), F.round(F.col("b") + 0.06 * (F.col("b") - F.col("a")), 5).alias("high"))


@query("SELECT doc_id, round(1 / (1 + exp(-((doc_id % 13) - 6.0))), 6) AS probability FROM labels")
def sigmoid(s, d):
    return table(s, d, "labels").select("doc_id", F.round(1 / (1 + F.exp(-((F.col("doc_id") % 13) - 6.0))), 6).alias("probability"))


@query()
def pca_project(s, d):
    """Standardised vectors on the two components that are fitted to node 0."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vector_items(s, d).select("key", "node", array_to_vector("vector").alias("raw"))
    base = rows.where("node = 0")
    n = base.count()
    wider = (n / max(1, n - 1)) ** 0.5  # to the population deviation; the components stay as they are
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(base)
    pca = PCA(k=2, inputCol="x", outputCol="p").fit(scaler.transform(base))
    return pca.transform(scaler.transform(rows)).select("key", "node", vector_to_array("p").alias("p")).select("key", "node", (F.get("p", F.lit(0)) * wider).alias("p0"), (F.get("p", F.lit(1)) * wider).alias("p1"))


def by_model(s, d, model, trees=300):
    items = vector_items(s, d)
    test = F.col("key") % 5 == 0
    return evaluate.trained_scores(items.where(~test), items.where(test), list(range(NODES)), model, trees)


@query()
def forest_per_node(s, d):
    return by_model(s, d, "forest")


@query()
def logistic_per_node(s, d):
    return by_model(s, d, "logistic")


RESULTS = """results AS (
  SELECT l_returnflag AS model, l_linestatus AS mode, CASE WHEN l_quantity < 10 THEN NULL ELSE floor(l_quantity / 10) / 10 END AS ratio,
    CAST(l_suppkey % 8 AS INTEGER) AS node, l_discount AS score FROM lineitem)"""


def results_of(s: SparkSession, d: str) -> DataFrame:
    """lineitem as results of runs: model, mode, ratio (null: full retention), node and a score."""
    ratio = F.when(F.col("l_quantity") >= 10, F.floor(F.col("l_quantity") / 10) / 10)
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("mode"), ratio.alias("ratio"), (F.col("l_suppkey") % 8).cast("int").alias("node"), F.col("l_discount").alias("score"))


@query(f"WITH {RESULTS} SELECT mode, ratio, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std FROM results GROUP BY ALL")
def results_mean_std(s, d):
    return evaluate.mean_std(results_of(s, d), ["mode", "ratio"], ["score"]).select("mode", "ratio", F.round("score_mean", 6).alias("score_mean"), F.round("score_std", 6).alias("score_std"))


@query(f"WITH {RESULTS} SELECT model, mode, ratio, round(avg(score), 6) AS score FROM results GROUP BY ALL")
def results_mean_per_setting(s, d):
    return evaluate.mean_per_setting(results_of(s, d), ["score"]).withColumn("score", F.round("score", 6))


@query(f"WITH {RESULTS} SELECT mode, ratio, node, round(max(score), 6) AS score FROM results WHERE mode = 'F' AND (ratio IS NULL OR ratio IN (0.1, 0.3)) GROUP BY ALL")
def results_subset_in_order(s, d):
    best = evaluate.subset(results_of(s, d), ["F"], [0.1, 0.3]).groupBy("mode", "ratio", "node").agg(F.round(F.max("score"), 6).alias("score"))
    return evaluate.in_order(best)


@query(f"WITH {RESULTS}, own AS (SELECT DISTINCT model AS mode, ratio FROM results WHERE ratio IS NOT NULL AND NOT (model = 'A' AND ratio > 0.25)) SELECT ratio, count(*) = (SELECT count(DISTINCT mode) FROM own) AS in_all FROM own GROUP BY ratio")
def results_ratio_sets(s, d):
    own = results_of(s, d).select(F.col("model").alias("mode"), "ratio").where("NOT (mode = 'A' AND coalesce(ratio, 0) > 0.25)")
    return evaluate.ratio_sets(own)


@query("SELECT CAST(doc_id % 8 AS INTEGER) AS node, count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality = 0) AS fn, count(*) FILTER (toxic = 0 AND quality = 0) AS tn FROM labels GROUP BY ALL")
def confusion_per_node(s, d):
    return evaluate.confusion_totals(table(s, d, "labels").select((F.col("doc_id") % 8).cast("int").alias("node"), F.col("toxic").alias("label"), F.col("quality").alias("predicted")), ["node"])


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) > (SELECT count(*) FROM events) - 777 AS in_test FROM events")
def time_split(s, d):
    train, test = prep.split_with_drift(table(s, d, "events"), "ts", "event_id", 777)
    return train.select("event_id", F.lit(False).alias("in_test")).unionByName(test.select("event_id", F.lit(True).alias("in_test")))


@query("SELECT c_custkey AS __id, c_mktsegment FROM customer")
def csv_round_trip(s, d):
    """Customers written as delimited text to the shared folder and scanned again."""
    path = tables.work_path(s, "csv")
    table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment").write.option("header", True).csv(path)
    return prep.with_global_id(tables.scan_delimited(s, path))


@query("SELECT CAST(c_custkey % 4 AS INTEGER) AS node, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY ALL")
def retained_round_trip(s, d):
    """Retained rows written, one directory per node, and scanned with their node."""
    path = f"{tables.work_path(s, 'retained')}/retained"
    kept = table(s, d, "customer").select((F.col("c_custkey") % 4).cast("int").alias("node"), F.col("c_custkey").alias("__id"), "c_name")
    tables.write_retained(kept, path)
    back = tables.read_retained(s, path)
    return back.groupBy(F.col("node").cast("int").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__id").cast("long")).alias("keys"))


# streaming


@query()
def stream_retention(s, d):
    raw = stream.read_stream(s, d, "embeddings")
    items = raw.select(X.owner(F.col("vec_id"), NODES).alias("node"), F.col("vec_id").alias("seq"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    room = capacity_of(s, d)
    return stream.drained(stream.retain_stream(items, room, config.max_representatives(room)), "retention")


@query("SELECT event_id // 1000 AS window_no, count(*) AS seen, round(avg(value), 5) AS mean_value FROM events GROUP BY ALL")
def stream_window_report(s, d):
    return stream.window_report(stream.read_stream(s, d, "events"), 1000).select("window_no", "seen", F.round("mean_value", 5).alias("mean_value"))
