"""Metrics over predictions and validation of trainers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.operators.prepare import k_fold


def attach_truth(pred: DataFrame, truth: DataFrame, key: str = "row_id") -> DataFrame:
    """Pair predictions and true labels on the row key."""
    return pred.join(truth, key)


def accuracy(pred: DataFrame) -> DataFrame:
    """``<accuracy, error_rate>``."""
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return pred.agg(hit.alias("accuracy"), (1.0 - hit).alias("error_rate"))


def micro_macro_precision(pred: DataFrame) -> DataFrame:
    """``<micro, macro>``: accuracy, and the mean precision over the labels present in the truth.

    Only the counts per (label, prediction) are shuffled; a label never predicted counts as 0.
    """
    pairs = pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    per_class = pairs.groupBy(F.col("prediction").alias("label")).agg(
        hits.alias("hits"), F.sum("n").alias("predicted")
    )
    truth = pairs.groupBy("label").agg(F.sum("n").alias("rows"))
    joined = truth.join(per_class, "label", "left")
    return joined.agg(
        (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("rows")).alias("micro"),
        F.avg(F.coalesce(F.col("hits") / F.col("predicted"), F.lit(0.0))).alias("macro"),
    )


def mae(pred: DataFrame) -> DataFrame:
    """``<mae>``."""
    return pred.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"))


def validate(
    train: DataFrame,
    test: DataFrame,
    fit: Callable,
    predict: Callable[..., DataFrame],
    metric: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Fit on ``train``, score ``test``, return the metric."""
    return metric(predict(test, fit(train)))


def cross_validate(
    df: DataFrame,
    fit: Callable,
    predict: Callable[..., DataFrame],
    metric: Callable[[DataFrame], DataFrame],
    k: int = 5,
    seed: int = 1,
    by: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """``(per fold, summary)``: the metrics of every fold, and ``<metric, mean, max, min>`` of each.

    The input is read once for each fold and is best persisted by the caller.
    """
    folds = k_fold(df, k, seed, by)
    results = []
    for i in range(k):
        train = folds.filter(F.col("fold") != i).drop("fold")
        test = folds.filter(F.col("fold") == i).drop("fold")
        results.append(validate(train, test, fit, predict, metric).withColumn("fold", F.lit(i)))
    per_fold = reduce(DataFrame.unionByName, results)
    named = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in per_fold.columns[:-1]]
    values = per_fold.select(F.explode(F.array(*named)).alias("m")).groupBy("m.metric")
    return per_fold, values.agg(
        F.avg("m.value").alias("mean"), F.max("m.value").alias("max"), F.min("m.value").alias("min")
    )
