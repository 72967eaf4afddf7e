"""What several operators share: words, stored intermediate tables, ordered running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.session import scratch_path

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six characters above."""
    return text.encode().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text; JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other one."""
    h = h ^ (h >> _MIX[2])
    h = h * _MIX[0]
    h = h ^ (h >> _MIX[2])
    h = h * _MIX[1]
    return h ^ (h >> _MIX[2])


class WordIds:
    """Numbers for the words a task has met, with one row of derived values per word.

    ``derive`` turns a list of new words into arrays, one value or row per word. The table is
    started anew once it holds ``limit`` words, so that memory stays bounded; values depend on
    the word alone, so this never changes a result.
    """

    def __init__(self, derive: Callable[[list[bytes]], dict[str, np.ndarray]], limit: int = 150_000):
        self.derive, self.limit = derive, limit
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.values: dict[str, np.ndarray] = {}
        self.filled = 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Positions of ``words`` in ``values``; call :meth:`fresh` between batches."""
        ids = self.ids
        new = list(set(words).difference(ids))
        ids.update(zip(new, range(len(ids), len(ids) + len(new))))
        out = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if new or not self.values:
            for name, got in self.derive(new).items():
                room = self.values.get(name)
                need = self.filled + len(new)
                if room is None or len(room) < need:
                    grown = np.zeros((max(1024, 2 * need), *got.shape[1:]), got.dtype)
                    if room is not None:
                        grown[: self.filled] = room[: self.filled]
                    self.values[name] = room = grown
                room[self.filled : need] = got
            self.filled = len(ids)
        return out

    def fresh(self) -> None:
        """Forget all words if there are too many; only between batches."""
        if self.filled > self.limit:
            self._reset()


def hash_bytes(words: list[bytes], seed: int = 0) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage; a lost executor loses nothing, and the files are columnar and compressed. While it
    runs, Python gets texts in batches of 8 MB, as two tasks of an executor hold theirs at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "8m")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(
    df: DataFrame, group: str, order: list[str], value: str, name: str, out: str = "sum_before"
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, in ``order``, within ``group``.

    The rows are range-partitioned by (group, order), so a group of any size is spread over many
    tasks. Each task adds up its own rows; what earlier partitions hold of the same group comes
    from a table of one row per group and partition.
    """
    keys = [group, *order]
    n = shuffle_partitions(df.sparkSession)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_within", T.LongType())]
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = column_of(batch, group).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            sizes = column_of(batch, value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.zeros(len(sizes), np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
            for a, b in zip(starts[:-1], starts[1:]):
                here = names.dictionary[int(codes[a])].as_py()
                if here != last:
                    last, total = here, 0
                ends = np.cumsum(sizes[a:b]) + total
                before[a:b] = ends - sizes[a:b]
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(before)],
                names=[*batch.schema.names, "_part", "_within"],
            )

    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    local = stored(ranged.mapInArrow(add, schema), name)
    totals = local.groupBy(group, "_part").agg(F.sum(value).alias("_total"))
    from pyspark.sql import Window

    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        local.join(offsets, [group, "_part"])
        .withColumn(out, F.col("_within") + F.col("_offset"))
        .drop("_part", "_within", "_offset")
    )


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``max_bytes`` of text each; a longer text is a part of its own."""
    lengths = pa.compute.binary_length(column_of(batch, text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // max_bytes
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column of ``x`` is all ones."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w
