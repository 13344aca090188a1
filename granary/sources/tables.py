"""Scans and sinks: delimited text, retained rows, metrics."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Up to so many files their headers' places are broadcast.
MANY_FILES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which Hadoop removes when the application ends.

    It lies in ``spark.checkpoint.dir``; where that is unset, a local master gets a folder of its own, and a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster must name a folder that its executors share")
        base = tempfile.mkdtemp(prefix="granary-")
    path = f"{base.rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def scan_delimited(spark: SparkSession, path: str, separator: str = ",", header: bool = True, quoted: bool = False) -> DataFrame:
    """Delimited text as string columns.

    Unquoted (the default): the separator's first character parts fields, quotes mean nothing, a blank line is one
    empty field, a byte-order mark goes from every line, and short rows end in nulls. ``quoted`` reads RFC 4180 text.
    """
    if quoted:
        return spark.read.option("header", header).option("escape", '"').option("sep", separator[0]).csv(path)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\uFEFF", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "c0 string")
    names = first["line"].split(separator[0])
    if header:
        # a file's header is the first of the lines equal to it in the file's first block; later equal lines are rows
        place = F.monotonically_increasing_id()
        same = (F.col("line") == first["line"]) & (F.col("start") == 0)
        lines = lines.withColumn("place", place)
        heads = lines.where(same).groupBy("file").agg(F.min("place").alias("place"))  # one row per file
        lines = lines.join(F.broadcast(heads) if len(lines.inputFiles()) <= MANY_FILES else heads, ["file", "place"], "left_anti")
    else:
        names = [f"c{k}" for k in range(len(names))]
    fields = F.split("line", re.escape(separator[0]), -1)
    return lines.select(*[F.get(fields, F.lit(k)).alias(n) for k, n in enumerate(names)])


def dataset_key(path: Column) -> Column:
    """The lower-case file stem without ``_train``; two names have a spelling of their own."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", "")), "_train$", "")
    return F.when(stem == "creditcard", "credit_card").when(stem == "foresttype", "forest_type").otherwise(stem)


def percent_of(ratio: Column) -> Column:
    """A ratio in whole percent, halves up."""
    return F.floor(ratio * 100 + 0.5).cast("int")


def percent_even(ratio: Column) -> Column:
    """A ratio in whole percent, halves to the even one."""
    return F.bround(ratio * 100, 0).cast("int")


def output_path(root: str, dataset: str, mode: str, ratio: float | None) -> str:
    return f"{root}/{dataset}/{mode}" + ("" if mode == "baseline" or ratio is None else f"/{math.floor(ratio * 100 + 0.5)}")


def write_retained(kept: DataFrame, path: str) -> None:
    """One directory per node, header and RFC 4180 quotes. A node's rows are one file, or several where they are many."""
    kept.hint("rebalance", "node").write.mode("overwrite").partitionBy("node").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_retained(spark: SparkSession, path: str) -> DataFrame:
    """All nodes' kept rows with their ``node``; needs ``__id``."""
    found = spark.read.option("header", True).option("escape", '"').csv(path)
    if "__id" not in found.columns:
        raise ValueError(f"{path} has no __id")
    return found


def available_ratios(spark: SparkSession, mode_dir: str) -> list[float]:
    """The ratios of a mode's outputs, from its directories that are whole percents."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mode_dir)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(hadoop) if f.isDirectory()] if system.exists(hadoop) else []
    return sorted(int(n) / 100 for n in names if n.isdigit())


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet dataset, by its extension."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"{path}: neither .csv nor .parquet")


def write_dataset(df: DataFrame, path: str) -> None:
    """CSV with a header, in as many files as ``df`` has partitions."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(spark: SparkSession, path: str, dataset: str, mode: str, ratio: float | None, nodes: int, sent: int) -> None:
    """One JSON object; a full run has no keepRatio."""
    row = {"dataset": dataset, "mode": mode, "keepRatio": None if mode == "baseline" else ratio, "nodes": nodes, "totalBytesSent": sent}
    spark.createDataFrame([tuple(row.values())], "dataset string, mode string, keepRatio double, nodes int, totalBytesSent long").coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Every metrics file below ``path`` by ratio; missing ratios are null."""
    schema = "dataset string, mode string, keepRatio double, nodes int, totalBytesSent long"
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).orderBy("keepRatio")
