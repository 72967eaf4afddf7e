"""Preparation of labelled frames: labels, bias, splits, folds, picks, numbering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfit.functions.arrays import unit_hash
from blockfit.operators.select import MAX_BROADCAST, kth_smallest, small_side
from blockfit.session import cut_lineage

_BUCKETS = 10000
_KEY_BUCKETS = 100
# up to here labels are looked up in a literal array, beyond in a joined table
_LITERAL_CLASSES = 32


def assemble(df: DataFrame, label_col: str) -> DataFrame:
    """All columns but the label into one vector, the label as double in front."""
    features = [c for c in df.columns if c != label_col]
    return df.select(
        F.col(label_col).cast("double").alias("label"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
    )


def distinct_labels(df: DataFrame) -> list:
    """The sorted class labels (K values)."""
    rows = df.select("label").filter(F.col("label").isNotNull()).groupBy("label").count().collect()
    return sorted(r["label"] for r in rows)


def label_index(df: DataFrame, classes: Sequence) -> DataFrame:
    """Replace ``label`` by its position in ``classes`` as a double; unknown labels give null."""
    dtype = df.schema["label"].dataType.simpleString()
    if len(classes) <= _LITERAL_CLASSES:
        table = F.array(*[F.lit(c).cast(dtype) for c in classes])
        at = F.array_position(table, F.col("label"))
        return df.withColumn("label", F.when(at > 0, (at - 1).cast("double")))
    lookup = df.sparkSession.createDataFrame(
        [(c, float(i)) for i, c in enumerate(classes)], f"label {dtype}, _index double"
    )
    joined = df.join(F.broadcast(lookup), "label", "left")
    return joined.select(*[F.col("_index").alias("label") if c == "label" else F.col(c) for c in df.columns])


def label_of(df: DataFrame, index: str, classes: Sequence, name: str) -> DataFrame:
    """Add ``name``: the class label at position ``index``; null for a null position."""
    if len(classes) <= _LITERAL_CLASSES:
        return df.withColumn(name, F.get(F.array(*[F.lit(c) for c in classes]), F.col(index)))
    # one row per class of a model that the driver holds anyway
    lookup = df.sparkSession.createDataFrame(list(enumerate(classes)), ["_at", name])
    joined = df.join(F.broadcast(lookup), F.col(index) == F.col("_at"), "left")
    return joined.drop("_at")


def index_labels(df: DataFrame) -> tuple[DataFrame, list]:
    """Index the distinct sorted labels to 0..K-1; works for 0-based, 1-based and any other labels."""
    classes = distinct_labels(df)
    return label_index(df, classes), classes


def with_bias(df: DataFrame) -> DataFrame:
    """Append a feature that is always 1."""
    return df.withColumn("features", F.concat(F.col("features"), F.array(F.lit(1.0))))


def one_hot(df: DataFrame, num_classes: int, label: str = "label") -> DataFrame:
    """Add ``onehot``: 1 at the label index, 0 elsewhere."""
    y = F.col(label).cast("int")
    codes = F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda j: (j == y).cast("double"))
    return df.withColumn("onehot", codes)


def _bucket(by: str, seed: int, buckets: int) -> Column:
    if by == "hash":
        return unit_hash("row_id", seed=seed, buckets=buckets)
    if by == "key":
        return F.pmod(F.col("row_id"), F.lit(buckets))
    raise ValueError(f"unknown split mode {by!r}")


def train_test_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 1, by: str = "hash"
) -> tuple[DataFrame, DataFrame]:
    """Random split that depends on ``row_id`` and the seed only, never on the layout.

    ``by="key"`` takes the first rows of every hundred row numbers to test (whole percents),
    ``by="random"`` needs no ``row_id``.
    """
    if by == "random":
        train, test = df.randomSplit([1 - test_size, test_size], seed)
        return train, test
    buckets = _BUCKETS if by == "hash" else _KEY_BUCKETS
    is_test = _bucket(by, seed, buckets) < round(test_size * buckets)
    return df.filter(~is_test), df.filter(is_test)


def k_fold(df: DataFrame, k: int = 5, seed: int = 1, by: str = "hash") -> DataFrame:
    """Add ``fold`` in 0..k-1; train of fold i is ``fold != i``."""
    return df.withColumn("fold", _bucket(by, seed, k).cast("int"))


def stratified_pick(
    df: DataFrame, pick_size: int, seed: int = 1, by: str = "hash", max_broadcast: int = MAX_BROADCAST
) -> tuple[DataFrame, DataFrame]:
    """``pick_size`` rows of every class to train, at least 1 and at most all but one; the rest to test.

    The only row of a class goes to test. The picked rows are those below a cut per
    class, found by counting; the rows themselves are neither shuffled nor sorted while the cuts, one row per
    class, are at most ``max_broadcast``. Any number of classes is possible.
    """
    key = F.xxhash64("row_id", F.lit(seed)) if by == "hash" else F.col("row_id")
    keyed = df.withColumn("_order", key)
    size = F.least(F.greatest(F.lit(pick_size), F.lit(1)), F.count("*") - 1)
    ranks = (
        keyed.groupBy("label")
        .agg(F.min("_order").alias("lo"), F.max("_order").alias("hi"), size.cast("long").alias("k"), F.count("*").alias("n"))
        .filter("k > 0")
    )
    cuts = kth_smallest(keyed, "_order", ranks, "label", max_broadcast).withColumnRenamed("label", "_class")
    tagged = keyed.join(small_side(cuts, cuts.count(), max_broadcast), F.col("label") == F.col("_class"), "left").withColumn(
        "_train", F.coalesce(F.col("_order") <= F.col("cut"), F.lit(False))
    )
    return (
        tagged.filter("_train").select(*df.columns),
        tagged.filter("NOT _train").select(*df.columns),
    )


def pick_classes(df: DataFrame, pick_size: int = 2, seed: int = 1, by: str = "hash") -> DataFrame:
    """The rows of ``pick_size`` classes, chosen by seeded hash or (``by="key"``) in label order."""
    labels = df.select("label").distinct()
    order = F.xxhash64("label", F.lit(seed)) if by == "hash" else F.col("label")
    return df.join(labels.orderBy(order, "label").limit(pick_size), "label", "left_semi").select(*df.columns)


def profile(df: DataFrame) -> DataFrame:
    """``<num_rows, num_classes, num_features>`` in one aggregation."""
    return df.agg(
        F.count("*").alias("num_rows"),
        F.count_distinct("label").alias("num_classes"),
        F.max(F.size("features")).alias("num_features"),
    )


def with_row_id(df: DataFrame, keys: Sequence[str] | str, name: str = "row_id") -> DataFrame:
    """Number the rows 0..n-1 in the order of ``keys``; rows of equal keys get numbers of their own.

    One range shuffle, written once; the numbers come from the rows per partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    placed = cut_lineage(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["_part"], total))
        total += row["count"]
    # one row per shuffle partition
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _offset long"))
    numbered = placed.withColumn("_part", part).join(table, "_part")
    return numbered.select((F.col("_offset") + local).alias(name), *df.columns)


def file_place() -> list[Column]:
    """Which split of which file a row comes from, for :func:`number_file_rows`."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]


def number_file_rows(df: DataFrame, name: str = "row_id", max_broadcast: int = 64 << 20) -> DataFrame:
    """Number the rows of files 0..n-1, by path and then by place in the file; no row moves.

    ``df`` has the columns of :func:`file_place`. One pass counts the rows of every split; prefix sums over the
    splits in file order give the first number of each, and a row adds its place within the split. So the
    numbers are those of the lines, however the files are split and packed to partitions. There is one count per
    split, which the driver lists anyway to plan the scan; they are broadcast up to ``max_broadcast`` bytes and joined
    by shuffle beyond. The splits must be the same when the rows are read as when they were counted: changing
    ``spark.sql.files.*`` in between is an error.
    """
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).toArrow()
    splits = splits.sort_by([("_file", "ascending"), ("_start", "ascending")])
    ends = np.cumsum(splits["_n"].to_numpy(), dtype=np.int64)
    splits = splits.append_column("_offset", pa.array(ends - splits["_n"].to_numpy(), pa.int64()))
    if not splits.num_rows:
        return df.select(F.lit(0).cast("long").alias(name), *_without_place(df))
    table = df.sparkSession.createDataFrame(splits)
    known = F.broadcast(table) if splits.nbytes <= max_broadcast else table.hint("shuffle_hash")
    local = F.col("_at") - F.col("_first")
    other = F.col("_n").isNull() | ~local.between(F.lit(0), F.col("_n") - 1)
    message = F.lit("the files are split otherwise than when their rows were counted")
    number = F.when(other, F.raise_error(message)).otherwise(F.col("_offset") + local)
    return placed.join(known, ["_file", "_start"], "left").select(number.alias(name), *_without_place(df))


def _without_place(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_file", "_start")]


def class_dictionary(df: DataFrame, label) -> DataFrame:
    """The rows of one class without the label."""
    return df.filter(F.col("label") == F.lit(label)).drop("label")


def with_block_column(df: DataFrame, col: str | None = None) -> DataFrame:
    """Take the block key of a row from a column, or from the last feature."""
    if col is not None:
        rest = [c for c in df.columns if c != col]
        return df.select(*rest, F.col(col).cast("int").alias("block_id"))
    x = F.col("features")
    return df.withColumn("block_id", x[F.size(x) - 1].cast("int")).withColumn(
        "features", F.slice(x, F.lit(1), F.size(x) - 1)
    )
