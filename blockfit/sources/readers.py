"""Readers that end in the labelled frame ``<row_id long, label double, features array<double>>``.

Files have no key, so their rows are numbered by path and place in the file, however the files are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.operators.prepare import file_place, number_file_rows, train_test_split, with_row_id


def _csv_width(spark: SparkSession, path: str, sep: str) -> int:
    line = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    if line is None:
        raise ValueError(f"no row in {path}")
    return len(line[0].split(sep))


def read_labeled_csv(
    spark: SparkSession,
    path: str,
    label: str = "last",
    sep: str = ",",
    num_columns: int | None = None,
) -> DataFrame:
    """Header-less numeric file, the label in the last (or first) column.

    The schema is all double and never inferred: one line is read for the width.
    """
    width = num_columns or _csv_width(spark, path, sep)
    names = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    raw = spark.read.csv(path, schema=schema, sep=sep, header=False, mode="FAILFAST")
    target = names[-1] if label == "last" else names[0]
    features = F.array(*[F.col(n) for n in names if n != target])
    return number_file_rows(raw.select(F.col(target).alias("label"), features.alias("features"), *file_place()))


def read_labeled_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``label,f1 f2 f3``: label first, features parted by blanks."""
    parts = F.split(F.col("value"), ",")
    numbers = F.split(F.trim(parts[1]), r"\s+")
    rows = (
        spark.read.text(path)
        .filter(F.length(F.trim("value")) > 0)
        .select(
            parts[0].cast("double").alias("label"),
            F.transform(numbers, lambda s: s.cast("double")).alias("features"),
            *file_place(),
        )
    )
    return number_file_rows(rows)


def load_train_test(
    spark: SparkSession,
    path: str,
    test_path: str | None = None,
    test_size: float = 0.2,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames from two files, or from a seeded random split of one."""
    train = read_labeled_csv(spark, path)
    if test_path is not None:
        return train, read_labeled_csv(spark, test_path)
    return train_test_split(train, test_size, seed)


def from_table(
    df: DataFrame,
    feature_cols: Sequence[str | Column] | str,
    label_col: str | Column,
    id_cols: Sequence[str] | str,
) -> DataFrame:
    """Labelled frame from table columns.

    ``feature_cols`` is a list of numeric columns or the name of one array or vector
    column. One integral id column is used as ``row_id`` as it is; several are numbered.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    if isinstance(feature_cols, str):
        field = df.schema[feature_cols]
        if isinstance(field.dataType, T.ArrayType):
            features = F.col(feature_cols).cast("array<double>")
        else:
            from pyspark.ml.functions import vector_to_array

            features = vector_to_array(F.col(feature_cols))
    else:
        cols = [F.col(c) if isinstance(c, str) else c for c in feature_cols]
        features = F.array(*[c.cast("double") for c in cols])
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    if len(ids) == 1:
        return df.select(
            F.col(ids[0]).cast("long").alias("row_id"), label.alias("label"), features.alias("features")
        )
    named = df.select(*ids, label.alias("label"), features.alias("features"))
    return with_row_id(named, ids).select("row_id", "label", "features")
