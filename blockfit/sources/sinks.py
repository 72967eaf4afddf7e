"""Writers for residual tables and models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfit.model import HISTORY_SCHEMA, Model


def write_residuals(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a residual table; as CSV the residual array becomes one blank-joined field."""
    if fmt == "csv":
        df = df.withColumn("residual", F.array_join(F.col("residual").cast("array<string>"), " "))
        df.write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).format(fmt).save(path)


def save_model(model: Model, path: str, mode: str = "errorifexists") -> None:
    """Model table, its parameters and its history below ``path``."""
    spark = model.spark
    meta = {
        "params": model.params,
        "bias": model.bias,
        "shape": list(model.W.shape),
        "regression": model.classes is None,
    }
    model.weights.write.mode(mode).parquet(f"{path}/weights")
    model.history.write.mode(mode).parquet(f"{path}/history")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).parquet(
        f"{path}/meta"
    )


def load_model(spark: SparkSession, path: str) -> Model:
    """Read back what :func:`save_model` wrote; p x K numbers reach the driver."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    table = spark.read.parquet(f"{path}/weights").toArrow()
    W = np.zeros(meta["shape"])
    k = table["class_idx"].to_numpy()
    W[table["feature_idx"].to_numpy(), k] = table["weight"].to_numpy()
    classes = None
    if not meta["regression"]:
        by_index = dict(zip(k.tolist(), table["class_label"].to_pylist()))
        classes = [by_index[i] for i in range(W.shape[1])]
    history = [r.asDict() for r in spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/history").collect()]
    return Model(spark, W, classes, meta["bias"], sorted(history, key=lambda r: r["round"]), meta["params"])
