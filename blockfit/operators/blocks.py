"""Row blocks, feature blocks and dense chunks of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.functions.arrays import unit_hash

CHUNK_SCHEMA = (
    "block_id long, chunk_id long, n int, p int, X binary, y array<double>, row_ids array<long>"
)
MAX_CHUNK_BYTES = 4 << 20


def row_blocks(df: DataFrame, num_blocks: int, by: str = "hash", seed: int = 0) -> DataFrame:
    """Add ``block_id`` in 0..N-1 from the row key alone."""
    if by == "hash":
        return df.withColumn("block_id", unit_hash("row_id", seed=seed, buckets=num_blocks).cast("int"))
    return df.withColumn("block_id", F.pmod(F.col("row_id"), F.lit(num_blocks)).cast("int"))


def row_range_chunks(df: DataFrame, num_blocks: int, num_rows: int | None = None) -> DataFrame:
    """Add ``block_id = floor(row_id / ceil(n / N))`` for row ids 0..n-1."""
    n = df.count() if num_rows is None else num_rows
    width = -(-n // num_blocks)
    return df.withColumn("block_id", F.floor(F.col("row_id") / F.lit(width)).cast("int"))


def feature_blocks(p: int, num_blocks: int, policy: str = "balanced") -> list[tuple[int, int]]:
    """Column ranges ``[lo, hi)``.

    ``ceil``: blocks ``ceil(p/N)`` wide, the last one takes the rest. ``balanced``: the
    first ``N - p mod N`` blocks are ``floor(p/N)`` wide, the others one wider.
    """
    if num_blocks < 1 or num_blocks > p:
        raise ValueError(f"{p} features cannot fill {num_blocks} blocks")
    if policy == "ceil":
        width = -(-p // num_blocks)
        if (num_blocks - 1) * width >= p:
            raise ValueError(
                f"blocks of {width} leave nothing for the last of {num_blocks} blocks over "
                f"{p} features; use policy='balanced'"
            )
        return [(i * width, min((i + 1) * width, p)) for i in range(num_blocks)]
    if policy != "balanced":
        raise ValueError(f"unknown policy {policy!r}")
    base, wider = divmod(p, num_blocks)
    widths = [base] * (num_blocks - wider) + [base + 1] * wider
    ends = np.cumsum(widths).tolist()
    return [(e - w, e) for e, w in zip(ends, widths)]


def split_features(df: DataFrame, blocks: Sequence[tuple[int, int]]) -> DataFrame:
    """One row per row and feature block: ``<block_id, row_id, label, slice>``."""
    parts = F.array(
        *[
            F.struct(
                F.lit(i).alias("block_id"),
                F.slice("features", F.lit(lo + 1), F.lit(hi - lo)).alias("slice"),
            )
            for i, (lo, hi) in enumerate(blocks)
        ]
    )
    return df.select("row_id", "label", F.explode(parts).alias("b")).select(
        "b.block_id", "row_id", "label", "b.slice"
    )


def place_blocks(df: DataFrame, num_partitions: int) -> DataFrame:
    """Put block ``b`` into partition ``b mod N``."""
    return df.repartitionById(num_partitions, F.pmod(F.col("block_id"), F.lit(num_partitions)).cast("int"))


def feature_block_view(
    df: DataFrame, blocks: Sequence[tuple[int, int]], rows_per_chunk: int = 4096
) -> DataFrame:
    """Every feature block over all rows in row order, as chunks of consecutive row ids.

    ``<block_id, chunk_id, row_ids, X>`` with ``X`` row-major. Chunk c holds the row ids
    from ``c * rows_per_chunk`` on, so no group outgrows ``rows_per_chunk`` rows.
    """
    chunk = F.floor(F.col("row_id") / F.lit(rows_per_chunk)).alias("chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("row_id", "slice")))
    return (
        split_features(df, blocks)
        .groupBy("block_id", chunk)
        .agg(ordered.alias("rows"))
        .select("block_id", "chunk_id", F.col("rows.row_id").alias("row_ids"), F.flatten("rows.slice").alias("X"))
    )


def spread_blocks(df: DataFrame, num_partitions: int | None = None, num_rows: int | None = None) -> DataFrame:
    """Shuffle rows by ``block_id``; only a block larger than a partition is spread over several.

    How many is decided by its rows, so a partition meets few blocks and no task gets a hot one.
    Without ``num_partitions`` the session decides, and adaptive execution may merge small ones.
    """
    fixed = () if num_partitions is None else (num_partitions,)
    if num_partitions is None:
        num_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy("block_id").agg(F.count("*").alias("_rows"))
    n = num_rows if num_rows is not None else sizes.agg(F.sum("_rows")).first()[0] or 0
    per_part = max(1, -(-n // num_partitions))
    # blocks above the mean partition size: fewer than there are partitions
    hot = [(r["block_id"], -(-r["_rows"] // per_part)) for r in sizes.filter(F.col("_rows") > per_part).collect()]
    if not hot:
        return df.repartition(*fixed, "block_id")
    kind = df.schema["block_id"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(hot, f"block_id {kind}, _parts long")
    salt = F.pmod(F.xxhash64("row_id", F.lit(7)), F.coalesce("_parts", F.lit(1)))
    salted = df.join(F.broadcast(table), "block_id", "left").withColumn("_salt", salt)
    return salted.repartition(*fixed, "block_id", "_salt").select(*df.columns)


def feature_matrix(batch: pa.RecordBatch, name: str = "features") -> np.ndarray:
    """The rows of a batch as a dense matrix, without a copy; null or missing features are an error."""
    column = batch.column(name)
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("null among the features")
    values = np.asarray(flat, dtype=np.float64)
    if batch.num_rows == 0:
        return values.reshape(0, 0)
    p, rest = divmod(len(values), batch.num_rows)
    lengths = np.diff(np.asarray(column.offsets))
    if rest or (lengths != p).any():
        raise ValueError("rows differ in their number of features")
    return values.reshape(batch.num_rows, p)


def _pack(max_bytes: int, whole_blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        sequence = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held_block, held_bytes = None, 0

        def chunk():
            nonlocal sequence, held, held_bytes
            X = np.concatenate([h[0] for h in held])
            y = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held_block], pa.int64()),
                    pa.array([base + sequence], pa.int64()),
                    pa.array([len(X)], pa.int32()),
                    pa.array([X.shape[1]], pa.int32()),
                    pa.array([X.tobytes()], pa.binary()),
                    pa.array([y], pa.list_(pa.float64())),
                    pa.array([ids], pa.list_(pa.int64())),
                ],
                names=["block_id", "chunk_id", "n", "p", "X", "y", "row_ids"],
            )
            sequence, held, held_bytes = sequence + 1, [], 0
            return out

        for batch in batches:
            if batch.num_rows == 0:
                continue
            X = feature_matrix(batch)
            y = np.asarray(batch.column("label"))
            ids = np.asarray(batch.column("row_id"))
            blocks = np.asarray(batch.column("block_id"))
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            per_chunk = max(1, max_bytes // max(1, X.shape[1] * 8))
            for lo, hi in zip(edges, edges[1:]):
                if held and blocks[lo] != held_block:
                    yield chunk()
                held_block = int(blocks[lo])
                while lo < hi:
                    room = hi - lo if whole_blocks else max(1, per_chunk - held_bytes // (X.shape[1] * 8))
                    end = min(hi, lo + room)
                    held.append((X[lo:end], y[lo:end], ids[lo:end]))
                    held_bytes += (end - lo) * X.shape[1] * 8
                    lo = end
                    if whole_blocks and held_bytes > max_bytes:
                        raise ValueError(
                            f"block {held_block} exceeds {max_bytes} bytes: raise num_blocks"
                        )
                    if not whole_blocks and held_bytes >= max_bytes - X.shape[1] * 8 + 1:
                        yield chunk()
        if held:
            yield chunk()

    return run


def pack_chunks(
    df: DataFrame,
    num_partitions: int | None = None,
    max_chunk_bytes: int = MAX_CHUNK_BYTES,
    whole_blocks: bool = False,
    sort: bool = True,
    num_rows: int | None = None,
) -> DataFrame:
    """Pack rows to dense chunks ``<block_id, chunk_id, n, p, X, y, row_ids>``.

    ``X`` is the row-major matrix as little-endian doubles. Without a ``block_id`` column
    the rows stay where they are and all get block 0. With one they are shuffled by block,
    a large block being spread over many tasks; ``whole_blocks`` instead keeps every block
    in one chunk. Rows are ordered within a partition
    (``sort=False`` saves that where the row order is of no account), which makes the
    chunks the same whenever they are computed again.
    """
    if "block_id" in df.columns:
        fixed = () if num_partitions is None else (num_partitions,)
        df = df.repartition(*fixed, "block_id") if whole_blocks else spread_blocks(df, num_partitions, num_rows)
        order = ["block_id", "row_id"] if sort else ["block_id"]
    else:
        df = df.withColumn("block_id", F.lit(0))
        order = ["row_id"] if sort else []
    rows = df.select(
        F.col("row_id").cast("long").alias("row_id"),
        F.col("block_id").cast("long").alias("block_id"),
        F.col("label").cast("double").alias("label"),
        F.col("features").cast("array<double>").alias("features"),
    )
    if order:
        rows = rows.sortWithinPartitions(*order)
    return rows.mapInArrow(_pack(max_chunk_bytes, whole_blocks), CHUNK_SCHEMA)


def chunk_matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row in the batch, X, y)`` of every chunk of a batch; views, not copies."""
    X, p, y = batch.column("X"), batch.column("p"), batch.column("y")
    for i in range(batch.num_rows):
        values = np.frombuffer(X[i].as_buffer(), dtype="<f8").reshape(-1, p[i].as_py())
        yield i, values, np.asarray(y[i].values)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, X, y in chunk_matrices(batch):
            n, p = X.shape
            features = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * p), pa.array(X.ravel())
            )
            block = pa.array(np.full(n, batch.column("block_id")[i].as_py()))
            yield pa.RecordBatch.from_arrays(
                [block, batch.column("row_ids")[i].values, pa.array(y), features],
                names=["block_id", "row_id", "label", "features"],
            )


def unpack_chunks(chunks: DataFrame) -> DataFrame:
    """The rows of the chunks again."""
    return chunks.select("block_id", "p", "X", "y", "row_ids").mapInArrow(
        _unpack, "block_id long, row_id long, label double, features array<double>"
    )
