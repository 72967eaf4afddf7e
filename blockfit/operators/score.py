"""Scoring by a fitted model; no action inside, so it applies to streaming frames as well."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.functions.arrays import class_margins, dot, whole_vector
from blockfit.model import Model
from blockfit.operators.linalg import SMALL_WIDTH, whole_rows
from blockfit.operators.prepare import label_of


def predict_linear(df: DataFrame, model: Model) -> DataFrame:
    """Add ``prediction = features . w``.

    A null vector, or one that holds a null, has no prediction; another length than the model's is
    an error.
    """
    w = model.W[:, 0]
    if len(w) <= SMALL_WIDTH**2:
        x = whole_vector("features", len(w))
        return df.withColumn("prediction", F.when(x.isNotNull(), dot("features", w)))

    @F.arrow_udf("double")
    def score(features: pa.Array) -> pa.Array:
        X, known = whole_rows(features, len(w))
        return pa.array(X @ w, mask=~known)

    return df.withColumn("prediction", score(F.col("features").cast("array<double>")))


def predict_class(df: DataFrame, model: Model) -> DataFrame:
    """Add ``prediction``: the label of the largest margin, the first one among equals.

    Null and ragged vectors are treated as by :func:`predict_linear`.
    """
    W = model.W[:-1] if model.bias else model.W
    shift = model.W[-1] if model.bias else np.zeros(model.W.shape[1])
    if W.size <= SMALL_WIDTH**2:
        plain = class_margins("features", W)
        margins = F.zip_with(plain, F.array(*[F.lit(float(b)) for b in shift]), lambda m, b: m + b)
        known = whole_vector("features", len(W)).isNotNull()
        best = F.when(known, (F.array_position(margins, F.array_max(margins)) - 1).cast("int"))
    else:

        @F.arrow_udf("int")
        def argmax(features: pa.Array) -> pa.Array:
            X, known = whole_rows(features, len(W))
            return pa.array((X @ W + shift).argmax(axis=1).astype(np.int32), mask=~known)

        best = argmax(F.col("features").cast("array<double>"))
    return label_of(df.withColumn("_best", best), "_best", model.classes, "prediction").drop("_best")
