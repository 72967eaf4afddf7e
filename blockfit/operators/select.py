"""Exact selection of the k-th smallest key without sorting or gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfit.session import cut_lineage, drop_checkpoint

_BINS = 4096
_LAST_SORT = 20_000
#: Rows of a table with one row per group up to which it is broadcast, after counting it.
MAX_BROADCAST = 100_000


def small_side(table: DataFrame, rows: int, most: int = MAX_BROADCAST) -> DataFrame:
    """``table`` broadcast if its ``rows``, as counted, are few; else joined by a sort-merge join.

    Adaptive execution splits the partitions of a frequent key there.
    """
    return F.broadcast(table) if rows <= most else table.hint("merge")


def kth_smallest(
    df: DataFrame, order: str, ranks: DataFrame, group: str, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """The ``k``-th smallest value of the long column ``order`` in every group.

    ``ranks`` is ``<group, lo, hi, k, n>`` with one row per group: the value range, the
    1-based rank looked for and the number of rows. Groups of at most ``_LAST_SORT`` rows are ranked by a
    window. The ranges of larger ones are a table: every level counts their rows in bins of the range and
    keeps the bin of the rank, until few rows are left, so that a group of any size is never in one task. No
    row of either table reaches the driver, and either is broadcast only up to ``max_broadcast`` rows.
    The values of ``order`` must be (nearly) unique; a null group has no cut. Returns ``<group, cut>``, checkpointed.
    """
    rows = df.select(group, order)
    known = cut_lineage(ranks.select(group, "lo", "hi", "k", "n").filter(F.col(group).isNotNull()))
    large = (F.col("n") > _LAST_SORT) & (F.col("lo") < F.col("hi"))
    sizes = known.agg(F.count("*").alias("all"), F.count_if(large).alias("wide")).first()
    few = known.filter(~large)
    light = small_side(few.select(group, "k"), sizes["all"] - sizes["wide"], max_broadcast)
    if sizes["wide"]:
        wide = _narrowed(rows, order, known.filter(large), group, sizes["wide"], max_broadcast)
        ranges = small_side(wide, sizes["wide"], max_broadcast)
        names = small_side(wide.select(group), sizes["wide"], max_broadcast)
        # the rows of large groups leave before the others are shuffled
        light_rows = rows.join(names, group, "left_anti").join(light, group)
        chosen = light_rows.unionByName(_inside(rows, order, ranges, group).select(group, order, "k"))
    else:
        wide, chosen = None, rows.join(light, group)
    ranked = chosen.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    # later uses do not read the data again
    cuts = cut_lineage(ranked.filter(F.col("_rank") == F.col("k")).select(group, F.col(order).cast("long").alias("cut")))
    drop_checkpoint(wide)
    drop_checkpoint(known)
    return cuts


def _inside(rows: DataFrame, order: str, ranges: DataFrame, group: str) -> DataFrame:
    return rows.join(ranges, group).filter(F.col(order).between(F.col("lo"), F.col("hi")))


def _whole(column: Column) -> Column:
    """Whole numbers beyond a long, as ``hi - lo`` may be."""
    return column.cast("decimal(20,0)")


def _narrowed(rows: DataFrame, order: str, wide: DataFrame, group: str, groups: int, max_broadcast: int) -> DataFrame:
    """The ranges of ``wide`` cut down until none holds more than ``_LAST_SORT`` rows."""
    per_group = Window.partitionBy(group).orderBy("lo")
    open_ranges = (F.col("n") > _LAST_SORT) & (F.col("lo") < F.col("hi"))
    wide = cut_lineage(wide)
    while wide.filter(open_ranges).limit(1).count():
        inside = _inside(rows, order, small_side(wide.drop("n"), groups, max_broadcast), group)
        lo, hi = _whole(F.col("lo")), _whole(F.col("hi"))
        width = F.floor((hi - lo) / _BINS) + 1
        binned = inside.withColumn("bin", F.floor((_whole(F.col(order)) - lo) / width).cast("int"))
        counts = binned.groupBy(group, "lo", "hi", "k", "bin").agg(F.count("*").alias("n"))
        start = (lo + F.col("bin") * width).cast("long")
        end = F.least(hi, lo + (F.col("bin") + 1) * width - 1).cast("long")
        found = cut_lineage(
            counts.select(group, "k", "n", start.alias("lo"), end.alias("hi"))
            .withColumn("upto", F.sum("n").over(per_group))
            .filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
            .select(group, "lo", "hi", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n")
        )
        drop_checkpoint(wide)
        wide = found
    return wide
