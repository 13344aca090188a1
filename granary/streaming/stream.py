"""Structured Streaming forms: stateful retention and count-window reports."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.stateful import EVENT, UtilityNode, decisions
from granary.sources.tables import work_path


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parque[t]")


def retain_stream(items: DataFrame, capacity: int, max_reps: int) -> DataFrame:
    """Decisions about a stream of (node, seq, key, vector); a node's state survives restarts in the checkpoint."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        node = pickle.loads(state.get[0]) if state.exists else UtilityNode(capacity, max_reps)
        yield decisions(int(key[0]), node, rows)
        state.update((pickle.dumps(node),))

    return items.groupBy("node").applyInPandasWithState(run, EVENT, "state binary", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream over existing files yields: written to the shared folder, then read."""
    spark = stream.sparkSession
    out, kept = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_counts(events: DataFrame, every: int) -> DataFrame:
    """Count windows of a stream: seen rows and mean value per window of ``every`` numbers."""
    return events.withColumn("window_no", F.floor(F.col("event_id") / every)).groupBy("window_no").agg(F.count(F.lit(1)).alias("seen"), F.avg("value").alias("mean_value"))


def window_report(events: DataFrame, every: int) -> DataFrame:
    """The report after all rows, kept up to date batch by batch in a table of the shared folder."""
    spark = events.sparkSession
    out, kept = work_path(spark, "report"), work_path(spark, "report-checkpoint")
    stream = window_counts(events, every)
    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", kept).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
