"""Exact deduplication: frequent digests are found by sketch and removed where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfit.llm.common import stored

#: Runs of white space that are not one space already; only these need a replacement.
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal_digest(text: Column) -> Column:
    """SHA-256 of a text with every run of white space as one space; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_SPACE, " ")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def frequent_digests(rows: DataFrame, tracked: int = 4096, buckets: int = 256) -> DataFrame:
    """``key``: hashes of the digests that a frequent-items sketch of the Misra-Gries family keeps.

    Every task keeps a sketch of at most ``tracked`` counters. The sketches are merged in two levels,
    ``buckets`` groups of tasks first, so no task merges those of all others. A digest with
    more than about 3.5 / (2 ``tracked``) of all rows is always among them; others may be, which
    does no harm. At most ``tracked`` rows.
    """
    bucket = F.pmod(F.spark_partition_id(), F.lit(buckets))
    parts = rows.groupBy(bucket.alias("bucket")).agg(
        F.expr(f"approx_top_k_accumulate(xxhash64(digest), {tracked})").alias("sketch")
    )
    # grouped, so that a table without rows has no sketch to merge
    merged = parts.groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("found"))
    return found.select(F.col("found.item").alias("key"))


def _winner() -> Column:
    """The smallest id, a null id last; of equal ids the row that was read first."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))


def exact_copies(docs: DataFrame, tracked: int = 4096, buckets: int = 256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (doc_id, text).

    Texts are equal if they are after replacing every run of white space by one space. Of equal
    texts the row with the smallest ``doc_id`` stays. The text is read once; what is stored and shuffled is
    its digest. Digests that a sketch finds frequent are counted exactly, with partial sums
    before the shuffle, and their winners, at most ``tracked``, are broadcast: rows of these are settled where
    they lie. The other digests are shuffled; none of them has more than a small share of the rows.

    A null text counts as empty, so null and empty texts are one group. Exactly one row of a group
    is ``kept``: among repeated rows of the smallest id one, and a null id only if there is no other.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col("doc_id"), F.monotonically_increasing_id().alias("row"), normal_digest(F.col("text")).alias("digest")
    )
    # stored, since the row numbers must be the same each time they are read
    rows = stored(rows, "digests")
    likely = F.broadcast(frequent_digests(rows, tracked, buckets))
    winners = (
        rows.withColumn("key", F.xxhash64("digest"))
        .join(likely, "key")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(_winner()).alias("winner"))
        .where(F.col("group_size") > 1)
    )
    winners = stored(winners, "frequent-digests")
    told = rows.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    others = (
        told.where(F.col("winner").isNull())
        .select("doc_id", "row", "digest")
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("winner", F.min(_winner()).over(group))
    )
    settled = told.where(F.col("winner").isNotNull()).select(*others.columns)
    return settled.unionByName(others).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
