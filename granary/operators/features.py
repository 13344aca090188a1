"""Sequence numbers, fitted statistics and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.expr import finite, safe_double, signed_log, spread_or_one

SEQ_BUCKET = 1 << 16


def with_seq(df: DataFrame, key: str, name: str = "seq") -> DataFrame:
    """Numbers rows from 0 in the order of a unique whole-number key.

    Rows are numbered inside ranges of the key and the ranges' offsets are added, so no task sees all rows.
    """
    own = df.withColumn("__range", F.floor(F.col(key) / SEQ_BUCKET))
    counts = own.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return own.withColumn("__in", inside).join(counts.withColumn("__before", before), "__range").withColumn(name, F.col("__before") + F.col("__in")).drop("__range", "__n", "__in", "__before")


def feature_columns(df: DataFrame, ignore: tuple[str, ...] = (), id_column: str | None = None) -> list[str]:
    """The columns that become features; names are compared trimmed, in exact case."""
    out = {x.strip() for x in ignore} | ({id_column.strip()} if id_column else set())
    return [c for c in df.columns if c.strip() not in out]


def prepared(column: Column, log: bool) -> Column:
    return signed_log(safe_double(column)) if log else safe_double(column)


def fit(df: DataFrame, columns: list[str], log: bool) -> DataFrame:
    """One row per column: mean, std (population), median, iqr. No rows: 0, 1, 0, 1."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), prepared(F.col(c), log).alias("x")) for c in columns])).alias("v")).select("v.*")
    quartile = lambda p: F.percentile("x", F.lit(p))
    return long.groupBy("column").agg(
        F.avg("x").alias("mean"), spread_or_one(F.stddev_pop("x")).alias("std"), quartile(0.5).alias("median"), spread_or_one(quartile(0.75) - quartile(0.25)).alias("iqr")
    )


def fit_row(df: DataFrame, columns: list[str], log: bool) -> dict[str, tuple[float, float, float, float]]:
    """The same statistics on the driver: one aggregate over bounded fit rows, four numbers per column."""
    aggs = []
    for k, c in enumerate(columns):
        x = prepared(F.col(c), log)
        aggs += [F.avg(x).alias(f"m{k}"), spread_or_one(F.stddev_pop(x)).alias(f"s{k}"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{k}")]
    r = df.agg(*aggs).first()
    out = {}
    for k, c in enumerate(columns):
        q = r[f"q{k}"] or [0.0, 0.0, 1.0]
        iqr = q[2] - q[0]
        out[c] = (r[f"m{k}"] or 0.0, r[f"s{k}"], q[1], iqr if iqr > 0 else 1.0)
    return out


def vector(columns: list[str], stats: dict[str, tuple[float, float, float, float]], transform: str) -> Column:
    """The float vector of a row; non-finite elements are 0."""
    log, robust = transform.startswith("log_"), transform.endswith("robust")
    cells = []
    for c in columns:
        mean, std, median, iqr = stats[c]
        x = prepared(F.col(c), log)
        y = (x - F.lit(median)) / F.lit(iqr) if robust else (x - F.lit(mean)) / F.lit(std)
        cells.append(F.coalesce(finite(y), F.lit(0.0)).cast("float"))
    return F.array(*cells)
