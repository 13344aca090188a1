"""Scores of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_class(pred: DataFrame) -> DataFrame:
    """(label, tp, n_true, n_pred) of (label, predicted)."""
    cells = pred.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    true = cells.groupBy("label").agg(F.sum(right).alias("tp"), F.sum("n").alias("n_true"))
    told = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_pred"))
    return true.join(told, "label", "full").fillna(0)


def accuracy_scores(pred: DataFrame) -> DataFrame:
    """macro_f1 over all classes, balanced_accuracy over true ones."""
    both = F.col("n_true") + F.col("n_pred")
    f1 = F.when(both > 0, 2.0 * F.col("tp") / both).otherwise(0.0)
    return per_class(pred).agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.avg(F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))), 6).alias("balanced_accuracy"))


def ranking_scores(scored: DataFrame) -> DataFrame:
    """average_precision and roc_auc of (label 0/1, score); equal scores are one step."""
    steps = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
    total = run.withColumn("all_pos", F.sum("pos").over(Window.partitionBy())).withColumn("all_n", F.sum("n").over(Window.partitionBy()))
    neg = F.col("n") - F.col("pos")
    higher = F.col("tp") - F.col("pos") + F.col("pos") / 2.0  # positives above, and half of the equal ones
    return total.agg(
        F.round(F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("seen")), 6).alias("average_precision"),
        F.round(F.sum(neg * higher) / F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))), 6).alias("roc_auc"),
    )


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight``, rows / (classes * rows of the class). One row per class is joined back."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    weights = n.select(label, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))
    return rows.join(weights, label)


def trained_scores(kept: DataFrame, test: DataFrame, nodes: list[int], model: str = "forest", trees: int = 300, seed: int = 1337) -> DataFrame:
    """(node, macro_f1, balanced_accuracy) of a model per node, trained on what it kept (node, label, vector), on one test set.

    ``forest``: a random forest with balanced class weights; ``logistic``: logistic regression on standardised features.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    as_features = lambda df: df.select("label", array_to_vector("vector").alias("raw"))
    shared, out = as_features(test).cache(), None
    for node in nodes:
        rows = balanced_weights(as_features(kept.where(F.col("node") == node)), "label").cache()
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
        if model == "forest":
            learner = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight", featuresCol="raw")
            stages = [learner]
        else:
            learner = LogisticRegression(maxIter=100, regParam=1.0 / max(1, rows.count()), weightCol="weight")
            stages = [scaler, learner]
        told = Pipeline(stages=stages).fit(rows).transform(shared).select("label", F.col("prediction").cast("int").alias("predicted"))
        scores = accuracy_scores(told).select(F.lit(node).alias("node"), "macro_f1", "balanced_accuracy")
        out = scores if out is None else out.unionByName(scores)
    return out


def mean_std(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over the nodes, one row per ``by``; nulls don't count."""
    return results.groupBy(*by).agg(*[f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def mean_per_setting(results: DataFrame, metrics: list[str]) -> DataFrame:
    """The mean of each metric per model, mode and ratio, in that order; full retention, whose ratio is null, comes first."""
    return results.groupBy("model", "mode", "ratio").agg(*[F.avg(m).alias(m) for m in metrics]).orderBy("model", "mode", F.asc_nulls_first("ratio"))


def in_order(results: DataFrame) -> DataFrame:
    """Results by mode, ratio (null first) and node. Results are one row per run and node."""
    return results.orderBy("mode", F.asc_nulls_first("ratio"), "node")


def subset(results: DataFrame, modes: list[str] | None = None, ratios: list[float] | None = None) -> DataFrame:
    """The results of some modes and ratios; full retention has no ratio and stays."""
    out = results if modes is None else results.where(F.col("mode").isin(modes))
    return out if ratios is None else out.where(F.col("ratio").isNull() | F.col("ratio").isin(ratios))


def ratio_sets(results: DataFrame) -> DataFrame:
    """(ratio, in_all): the ratios that any mode has, and whether all modes with ratios have it."""
    own = results.where(F.col("ratio").isNotNull()).select("mode", "ratio").distinct()
    modes = own.agg(F.count_distinct("mode").alias("modes"))
    return own.groupBy("ratio").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(modes), F.lit(True)).select("ratio", (F.col("n") == F.col("modes")).alias("in_all"))


def confusion_totals(pred: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of (label 0/1, predicted 0/1), summed over all rows of each ``by``."""
    cell = lambda label, told: F.count_if((F.col("label") == label) & (F.col("predicted") == told)).cast("long")
    return pred.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
