"""Element-wise sums of many partial vectors, as a tree of shuffles planned from bytes x partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.functions.arrays import collect_sum

#: Bytes of partial vectors that one task reads at most.
READ_LIMIT = 64 << 20
#: Numbers of a vector that are added in one task.
SEGMENT = 1 << 16
#: Tasks of a level; with more groups than that a task adds up several, one after the other.
MAX_TASKS = 20_000
#: Sizes from which on a plan does not know what it reads.
_UNKNOWN = 1 << 60


def tree_levels(num_partials: int, num_bytes: int, limit: int | None = None) -> list[int]:
    """How many partial sums are left after each level, for ``num_partials`` vectors of ``num_bytes``.

    Every task reads at most ``limit`` bytes, or two vectors; what the last level leaves is within that bound as
    well. No level is needed while the partial vectors fit one task.
    """
    fan_in = max(2, (limit or READ_LIMIT) // max(1, num_bytes))
    levels = []
    while num_partials > fan_in:
        num_partials = -(-num_partials // fan_in)
        levels.append(num_partials)
    return levels


def partition_bound(df: DataFrame) -> int:
    """About the most partitions ``df`` can have: those of its files, or of a shuffle, if it has one.

    A plan that does not know its size counts with the partitions of the session.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length())]
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    ))
    read = 2 * sum(s for s in sizes if s < _UNKNOWN) // split
    return max(read, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def level_of(df: DataFrame, by: Sequence[str], left: int, num_groups: int, fan_in: int) -> DataFrame:
    """The rows of ``df`` dealt out for one level: ``left`` sums for each of ``num_groups`` groups.

    The rows of up to ``fan_in`` partitions, or of as many sums before, meet in one task. Placed by number and not by
    hash, so no task gets the rows of two sums by chance while there are enough tasks.
    """
    place = F.col("_place") if "_place" in df.columns else F.spark_partition_id()
    salt = F.floor(place / F.lit(fan_in)).cast("int")
    tasks = min(MAX_TASKS, left * num_groups)
    group = F.pmod(F.xxhash64(*by), F.lit(num_groups)).cast("int") if by and num_groups > 1 else F.lit(0)
    if len(by) == 1 and dict(df.dtypes)[by[0]] in ("int", "bigint"):
        group = F.pmod(F.col(by[0]), F.lit(num_groups)).cast("int")
    salted = df.withColumn("_place", salt)
    task = F.pmod(group * F.lit(left) + F.col("_place"), F.lit(tasks)).cast("int")
    return salted.withColumn("_task", task).repartitionById(tasks, F.col("_task"))


def tree_sum(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    width: int | None = None,
    num_partials: int | None = None,
    num_groups: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Element-wise sum of a vector column per group, ``<by.., col>``.

    ``num_partials`` is the number of partitions that hold vectors of a group (an upper bound; by default from the plan),
    ``width`` the length of the vectors and ``num_groups`` the number of groups. The vectors of a group
    are added in as many levels as it takes that no task reads more than ``limit`` bytes of them. Vectors
    longer than ``SEGMENT`` are cut, the segments are groups of their own, and only their sums meet again. Without
    ``width`` vectors count as ``SEGMENT`` long.

    Groups without rows do not appear; null vectors are left out. Vectors of a group must be of one length.
    """
    if width is not None and width > SEGMENT:
        segments = -(-width // SEGMENT)
        pieces = F.transform(
            F.sequence(F.lit(0), F.lit(segments - 1)),
            lambda i: F.struct(i.alias("segment"), F.slice(col, i * SEGMENT + 1, F.lit(SEGMENT)).alias(col)),
        )
        num_partials = num_partials or partition_bound(df)
        cut = df.select(*by, F.explode(pieces).alias("_e")).select(*by, "_e.segment", f"_e.{col}")
        cut = cut.where(F.size(col) > 0)  # groups may have shorter vectors than ``width``
        summed = tree_sum(cut, col, [*by, "segment"], SEGMENT, num_partials, num_groups * segments, limit)
        joined = F.transform(F.array_sort(F.collect_list(F.struct("segment", col))), lambda s: s[col])
        return summed.groupBy(*by).agg(F.flatten(joined).alias(col))
    num_bytes = 8 * (width or SEGMENT)
    fan_in = max(2, (limit or READ_LIMIT) // num_bytes)
    rows = df.select(*by, col)
    for left in tree_levels(num_partials or partition_bound(df), num_bytes, limit):
        dealt = level_of(rows, by, left, num_groups, fan_in)
        rows = dealt.groupBy(*by, "_place", "_task").agg(collect_sum(col).alias(col)).drop("_task")
    return rows.groupBy(*by).agg(collect_sum(col).alias(col))
