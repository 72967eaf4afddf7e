"""Where a job may write: the checkpoint folder of the session and scratch folders below it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (a test) may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="blockfit-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; keeps the partitioning of ``df``, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame | None) -> None:
    """Delete the files behind a frame made by :func:`cut_lineage`."""
    if df is None:
        return
    saved = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if saved.isDefined():
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(saved.get())
        conf = df.sparkSession._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def fixed_plans(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Plan without adaptive execution, for rounds over cached data of known layout.

    Adaptive execution runs every cached table as a stage of its own, which costs more
    than a round itself and has nothing to decide there. ``partitions`` is the layout of
    the cached side of a join: with as many shuffle partitions only the other side moves.
    Chunks go to Python in batches of a few, which is faster than the default batch size.
    """
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def partition_count(spark: SparkSession, num_bytes: int, chunk_bytes: int, most_bytes: int = 128 << 20) -> int:
    """Partitions for data of a known size: as many as the session wants, yet at most one
    per chunk, and always enough to keep a partition below ``most_bytes``.

    At least 2, since a single partition does not count as partitioned by a key.
    """
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, -(-num_bytes // most_bytes), min(wanted, -(-num_bytes // chunk_bytes)))
