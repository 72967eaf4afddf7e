import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Labelled frame from arrays; row ids are the positions unless given."""

    def build(X, y, ids=None, parts=3, **extra):
        import pyarrow as pa

        X = np.asarray(X, dtype=float)
        ids = np.arange(len(X)) if ids is None else np.asarray(ids)
        columns = {
            "row_id": pa.array(ids, pa.int64()),
            "label": pa.array(list(y)),
            "features": pa.array(list(X), pa.list_(pa.float64())),
            **{k: pa.array(v) for k, v in extra.items()},
        }
        return spark.createDataFrame(pa.table(columns)).repartition(parts)

    return build
