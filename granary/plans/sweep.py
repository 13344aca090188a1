"""A whole run: scan, features, retention at every ratio, outputs.

``python -m granary SETTINGS.json OUT`` writes, per ratio, ``OUT/<dataset>/<mode>[/<percent>]/retained`` (a directory per
node) and ``.../metrics``, and returns or prints a row of totals per node and ratio.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import config
from granary.functions import expr as X
from granary.operators import features, fleet, gossip, retention, rounds, stateful, vectors
from granary.sources import tables

TOTALS = ("node", "seen", "admitted", "dropped", "evicted", "stored", "stored_bytes", "bytes_sent")
OWN = ("__seq", "__key", "__node", "__payload", "__vector")


def load(spark: SparkSession, cfg: config.RetentionConfig) -> tuple[DataFrame, int]:
    """(the input's columns with __seq, __key, __node, __payload and __vector, its rows). Row order is that of the file.

    The scan is written out once, numbered, so that a row's number is the same in every later job.
    """
    raw = spark.read.parquet(cfg.path) if cfg.path.endswith(".parquet") else tables.scan_delimited(spark, cfg.path, cfg.separator)
    numbered = features.with_seq(raw.withColumn("__place", F.monotonically_increasing_id()), "__place", "__seq").drop("__place")
    path = tables.work_path(spark, "input")
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    names = features.feature_columns(raw, cfg.ignore, cfg.id_column)
    transform = config.transform_name(cfg.transform)
    stats = features.fit_row(rows.where(F.col("__seq") < cfg.fit_rows), [f"`{n}`" for n in names], transform.startswith("log_"))
    ident = F.col(f"`{cfg.id_column}`") if cfg.id_column else F.lit(None)
    return rows.withColumns({
        "__key": X.key_of(ident, F.col("__seq")), "__node": X.owner(F.col("__seq"), cfg.nodes),
        "__payload": X.payload_bytes(*[F.col(f"`{n}`") for n in raw.columns]), "__vector": features.vector([f"`{n}`" for n in names], stats, transform),
    }), rows.count()


def items_of(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(c[2:]) for c in OWN])


def full(items: DataFrame, cfg: config.RetentionConfig, fanout: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, deliveries, totals) when every node keeps all that reaches it."""
    if cfg.nodes == 1 or cfg.order == "free":
        kept, sent = items.select("node", "key"), items.select(F.col("node").alias("src"), F.col("node").alias("dst"), "key", "payload").where("false")
    else:
        # draws repeat after a fixed number of epochs, which keeps the table of peers small
        epoch = (F.floor(F.col("seq") / 50) % 64).cast("int")
        sent, kept = gossip.spread(items.withColumn("epoch", epoch), gossip.peers(items.sparkSession, cfg.nodes, fanout, 64), cfg.ttl)
        kept = kept.select(F.col("dst").alias("node"), "key")
    arrived = sent.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("arrived"))
    own = items.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    held = kept.groupBy("node").agg(F.count(F.lit(1)).alias("admitted"))
    seen = F.col("own") + F.coalesce("arrived", F.lit(0))
    totals = own.join(held, "node").join(arrived, "node", "left").select("node", seen.alias("seen"), "admitted", (seen - F.col("admitted")).alias("dropped"), F.lit(0).cast("long").alias("evicted"))
    return kept, sent, totals


def bounded(items: DataFrame, cfg: config.RetentionConfig, fanout: int, n_rows: int, room: int, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, deliveries, totals) under a budget of ``room`` rows per node."""
    reps = min(cfg.max_reps or config.max_representatives(room), max(1, room - 1))
    nothing = items.select(F.col("node").alias("src"), F.col("node").alias("dst"), "key", "payload").where("false")
    if cfg.order == "free":
        if cfg.mode.lower() == "random":
            kept = retention.uniform(items, room).select("node", "key")
        else:
            reps = min(reps, vectors.REPS_LIMIT)
            own = items.select("node", "key", "vector")
            chosen, size = vectors.representatives(own, reps), vectors.bytes_of(cfg.nodes, reps, dim)
            near = vectors.two_nearest(vectors.non_reps(own, chosen, size), chosen, size)
            scored = vectors.utilities(near, vectors.bins(near), room, reps, cfg.gamma, cfg.balance_min, cfg.balance_max, size)
            kept = chosen.select("node", "key").unionByName(vectors.keep_best(scored, max(0, room - reps)).select("node", "key"))
        seen = items.groupBy("node").agg(F.count(F.lit(1)).alias("seen"))
        held = kept.groupBy("node").agg(F.count(F.lit(1)).alias("admitted"))
        zero = F.lit(0).cast("long")
        return kept, nothing, seen.join(held, "node").select("node", "seen", "admitted", (F.col("seen") - F.col("admitted")).alias("dropped"), zero.alias("evicted"))
    step = max(1, -(-n_rows // cfg.rounds))
    number = F.floor(F.col("seq") / step)
    events, sent = rounds.simulate(
        items, cfg.mode.lower(), room, reps, cfg.nodes, fanout, number, cfg.rounds, cfg.ttl, gamma=cfg.gamma, lo=cfg.balance_min, hi=cfg.balance_max
    )
    return stateful.stored(events), sent, rounds.counters(events).select("node", "seen", "admitted", "dropped", "evicted")


def interleaved(items: DataFrame, cfg: config.RetentionConfig, fanout: int, room: int, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, bytes by sender, totals) of a fleet that gossips between rows; its reports are written to ``path``/reports."""
    reps, view = min(cfg.max_reps or config.max_representatives(room), max(1, room - 1)), min(cfg.view or config.overlay_sizes(cfg.nodes)[0], max(1, cfg.nodes - 1))
    how = fleet.Fleet(cfg.nodes, fanout, view, cfg.shuffle or view, cfg.swap, cfg.cycle, cfg.batch, cfg.queue, max(1, cfg.ttl), cfg.report_every)
    work = tables.work_path(items.sparkSession, "fleet")
    fleet.simulate(items, [(cfg.mode.lower(), room, reps)], how, gamma=cfg.gamma, lo=cfg.balance_min, hi=cfg.balance_max).write.parquet(work)
    events = items.sparkSession.read.schema(fleet.EVENT).parquet(work)
    events.where("kind = 'REPORT'").drop("run", "kind", "key").write.mode("overwrite").json(f"{path}/reports")
    last = fleet.finals(events)
    return fleet.stored(events).select("node", "key"), last.select(F.col("node").alias("src"), F.col("bytes_sent").alias("payload")), last.select("node", "seen", "admitted", "dropped", "evicted")


def run(spark: SparkSession, cfg: config.RetentionConfig, out: str) -> DataFrame:
    """Totals per node and ratio (``ratio`` is null for full retention), after all outputs are written.

    All ratios are checked before the first one runs; two that round to the same percent would share a directory and are refused.
    """
    mode = cfg.mode.lower()
    ratios = [None] if mode == "baseline" else list(cfg.ratios)
    paths = [tables.output_path(out, dataset_name(cfg.path), mode, r) for r in ratios]
    if len(set(paths)) < len(paths):
        raise ValueError(f"ratios {cfg.ratios} share output directories")
    rows, n_rows = load(spark, cfg)
    if mode == "utility" and any(config.budget(n_rows, r) < 2 for r in ratios):
        raise ValueError("utility retention needs a budget of two rows or more")
    if rows.groupBy("__key").count().where("count > 1").limit(1).count():
        raise ValueError("keys must be unique")
    items, fanout = items_of(rows), min(cfg.fanout or config.overlay_sizes(cfg.nodes)[1], max(1, cfg.nodes - 1))
    dim = len(features.feature_columns(rows.drop(*OWN), cfg.ignore, cfg.id_column))
    found = []
    for ratio, path in zip(ratios, paths, strict=True):
        if ratio is None:
            kept, sent, totals = full(items, cfg, fanout)
        elif cfg.order == "interleaved":
            kept, sent, totals = interleaved(items, cfg, fanout, config.budget(n_rows, ratio), path)
        else:
            kept, sent, totals = bounded(items, cfg, fanout, n_rows, config.budget(n_rows, ratio), dim)
        # what is kept is met three times below, and computed once
        once = tables.work_path(spark, "kept")
        kept.write.parquet(once)
        kept = spark.read.schema(kept.schema).parquet(once)
        names = [c for c in rows.columns if c not in OWN]
        ident = [] if "__id" in names else [F.col("__key").alias("__id")]
        whole_rows = kept.join(rows, kept["key"] == rows["__key"]).select("node", *ident, *[F.col(f"`{c}`") for c in names])
        tables.write_retained(whole_rows, f"{path}/retained")
        bytes_out = sent.groupBy(F.col("src").alias("node")).agg(F.sum("payload").alias("bytes_sent"))
        held = kept.groupBy("node").agg(F.count(F.lit(1)).alias("stored"))
        whole = totals.join(held, "node", "left").join(bytes_out, "node", "left").fillna(0).withColumn("stored_bytes", F.col("stored") * (24 + 8 * dim)).select(*TOTALS).withColumn("ratio", F.lit(ratio).cast("double"))
        work = tables.work_path(spark, "totals")
        whole.coalesce(1).write.parquet(work)
        found.append(spark.read.schema(whole.schema).parquet(work))
        total = found[-1].agg(F.sum("bytes_sent")).first()[0] or 0
        tables.write_metrics(spark, f"{path}/metrics", dataset_name(cfg.path), mode, ratio, cfg.nodes, total)
    return reduce(DataFrame.unionByName, found)


def dataset_name(path: str) -> str:
    """``tables.dataset_key`` for a path on the driver."""
    stem = path.rstrip("/").rpartition("/")[2].rsplit(".", 1)[0].lower().removesuffix("_train")
    return {"creditcard": "credit_card", "foresttype": "forest_type"}.get(stem, stem)
