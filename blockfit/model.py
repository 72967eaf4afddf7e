"""A fitted model: p x K numbers on the driver, offered as tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HISTORY_SCHEMA = "round int, primal double, dual double, diff double, loss double"


@dataclass
class Model:
    """Weights ``W`` (features x classes, bias in the last row if ``bias``) and the fit history.

    ``classes`` holds the sorted class labels, or ``None`` for a regression model.
    """

    spark: SparkSession
    W: np.ndarray
    classes: list | None = None
    bias: bool = False
    history_rows: list[dict] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def num_features(self) -> int:
        return self.W.shape[0] - int(self.bias)

    @property
    def weights(self) -> DataFrame:
        """``<class_idx int, class_label, feature_idx int, weight double>``."""
        p, k = self.W.shape
        labels = self.classes if self.classes is not None else [0.0]
        table = pa.table(
            {
                "class_idx": pa.array(np.repeat(np.arange(k), p), pa.int32()),
                "class_label": pa.array(labels).take(pa.array(np.repeat(np.arange(k), p))),
                "feature_idx": pa.array(np.tile(np.arange(p), k), pa.int32()),
                "weight": pa.array(np.ascontiguousarray(self.W.T).ravel()),
            }
        )
        return self.spark.createDataFrame(table)

    @property
    def history(self) -> DataFrame:
        """``<round, primal, dual, diff, loss>``, one row per checked round."""
        names = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
        rows = [tuple(r.get(name) for name in names) for r in self.history_rows]
        return self.spark.createDataFrame(rows, HISTORY_SCHEMA)
