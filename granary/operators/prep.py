"""Samples, splits and encodings that prepare a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.expr import dice, finite
from granary.operators.features import with_seq
from granary.operators.retention import first_rows, mixed_bucket

#: The names of id columns, and the mark of a missing category.
ID_NAMES = ("__id", "id", "ID", "Id", "key", "Key")
MISSING = "<NA>"


def quotas(df: DataFrame, label: str, size: int) -> DataFrame:
    """(label, quota): largest remainders; ties go to the smaller label. One row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    exact = F.col("n") * F.lit(size) / total
    told = counts.withColumn("whole", F.floor(exact)).withColumn("part", exact - F.floor(exact))
    left = F.lit(size) - F.sum("whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.round("part", 9)), label))
    return told.withColumn("left", left).withColumn("place", place).select(label, (F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified(df: DataFrame, key: str, label: str, wanted: DataFrame) -> DataFrame:
    """``quota`` rows of each class, uniformly. Classes may be many, so nothing is broadcast by force."""
    own = df.withColumn("__mixed", dice(F.lit("s"), F.col(key)))
    return first_rows(own, label, mixed_bucket(F.col("__mixed")), wanted, "__mixed", key, bounded=False).drop("__mixed")


def uniform_rows(df: DataFrame, key: str, size: int, salt: str = "u") -> DataFrame:
    """``size`` rows, uniformly, of one group that is never sorted as a whole."""
    own = df.withColumn("__mixed", dice(F.lit(salt), F.col(key))).withColumn("__all", F.lit(0))
    return first_rows(own, "__all", mixed_bucket(F.col("__mixed")), size, "__mixed", key).drop("__mixed", "__all")


def encoder(train: DataFrame, column: str) -> DataFrame:
    """(value, code): the training values in order; null is a value."""
    value = categorical(F.col(column)).alias("value")
    return train.select(value).distinct().withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a categorical column in the order of its values; null is a value."""
    return df.groupBy(categorical(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def categorical(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``column`` as its code; values that training did not have are -1."""
    return df.withColumn("value", categorical(F.col(column))).join(codes, "value", "left").withColumn(column, F.coalesce("code", F.lit(-1)).cast("int")).drop("value", "code")


def reindexed(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the columns of the training features; missing ones are 0, others go."""
    return df.select([F.col(f"`{n}`") if n in df.columns else F.lit(0.0).alias(n) for n in names])


def numeric_only(df: DataFrame) -> DataFrame:
    """The numeric columns as doubles; nulls, NaN and infinities are 0."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select([F.coalesce(finite(F.col(f"`{n}`").cast("double")), F.lit(0.0)).alias(n) for n, t in df.dtypes if t in kinds or t.startswith("decimal")])


def sample(df: DataFrame, key: str, label: str | None, size: int, kind: str, positive: float | None = None) -> DataFrame:
    """``size`` rows: ``regression`` uniformly, ``multiclass`` by the classes' shares, ``binary`` also at a wanted share of label 1.

    Fewer rows than wanted, in all or of a class, are an error.
    """
    if kind == "regression":
        if (have := df.count()) < size:
            raise ValueError(f"there are {have} rows, {size} are wanted")
        return uniform_rows(df, key, size)
    if kind not in ("multiclass", "binary"):
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "binary" and positive is not None:
        ones = round(size * positive)
        wanted = df.sparkSession.createDataFrame([(0, size - ones), (1, ones)], f"{label} int, quota long")
    else:
        wanted = quotas(df, label, size)
    have = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(have, label, "left").where(F.coalesce("n", F.lit(0)) < F.col("quota")).first()
    if short:
        raise ValueError(f"class {short[label]} has {short['n'] or 0} rows, {short['quota']} are wanted")
    return stratified(df, key, label, wanted)


def with_global_id(df: DataFrame) -> DataFrame:
    """The first id column found, renamed and cast; without one, rows are numbered from 0 in the order of the scan."""
    for name in ID_NAMES:
        if name in df.columns:
            return df.withColumnRenamed(name, "__id").withColumn("__id", F.col("__id").cast("long"))
    return with_seq(df.withColumn("__place", F.monotonically_increasing_id()), "__place", "__id").drop("__place")


def split_with_drift(df: DataFrame, time: str, key: str, test_rows: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the ``test_rows`` latest rows by ``time`` are the test set, ties go to the larger ``key``, a unique number. Too few rows are an error.

    Rows are counted in buckets of time; only the bucket at the cut is sorted.
    """
    at = F.col(time).cast("timestamp") if dict(df.dtypes)[time] in ("date", "timestamp", "timestamp_ntz") else F.col(time)
    number = at.cast("double")
    have, first, last = df.agg(F.count(F.lit(1)), F.min(number), F.max(number)).first()
    if have <= test_rows:
        raise ValueError(f"there are {have} rows, {test_rows} of them are wanted for the test")
    bucket = F.floor((F.lit(last) - number) / F.lit(max(last - first, 1e-9)) * 4095)
    own = df.withColumns({"__all": F.lit(0), "__time": -number, "__key": -F.col(key)})
    late = first_rows(own, "__all", bucket, test_rows, "__time", "__key").select(F.col(key).alias("__test"))
    met = F.col(key) == F.col("__test")
    return df.join(late, met, "left_anti"), df.join(late, met, "left_semi")
