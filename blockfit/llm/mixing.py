"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.llm.common import running_sums, shuffle_partitions, stored, word_count


def source_targets(
    sources: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float
) -> DataFrame:
    """Adds ``target`` to one row per source ``<_source, source_size, ...>``.

    Sources in code point order take ``weights`` in turn and share ``share`` times all words. A
    target stops at ``max_repeats`` times its source; the excess goes to the others by weight. The
    common level (words per unit of weight) is found by a few sums over the sources: it only
    rises, and a source once at its limit stays there, so it stops after at most one sum each.
    """
    spark = sources.sparkSession
    n = shuffle_partitions(spark)
    ordered = sources.repartitionByRange(n, "_source").sortWithinPartitions("_source")
    placed = stored(
        ordered.select(
            "*",
            F.spark_partition_id().alias("_part"),
            (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_place"),
        ),
        "sources",
    )
    # one count per partition, as many as the session has shuffle partitions
    sizes = dict(placed.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not offsets:
        return sources.withColumn("target", F.lit(0.0))
    index = F.create_map(*offsets)[F.col("_part")] + F.col("_place")
    choice = F.array(*[F.lit(float(w)) for w in weights])
    weighted = placed.withColumn(
        "_weight", F.element_at(choice, (index % len(weights) + 1).cast("int"))
    ).withColumn("_limit", F.col("source_size") * F.lit(float(max_repeats)))
    words = weighted.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = share * words, 0.0
    while True:
        full = F.col("_limit") <= F.lit(level) * F.col("_weight")
        taken, rest = weighted.agg(
            F.sum(F.when(full, F.col("_limit")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))),
        ).first()
        if not rest:
            break
        raised = (wanted - taken) / rest
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_limit"), F.lit(level) * F.col("_weight"))
    return weighted.withColumn("target", target).drop("_part", "_place", "_weight", "_limit")


def _mixed(
    docs: DataFrame, weights: tuple[float, ...], share: float, max_repeats: float, seed: str, carry: tuple[str, ...]
) -> DataFrame:
    """The mix, with the columns ``carry`` as a struct ``_carried``."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}"))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10)
    rows = docs.select(
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("_source"),
        "doc_id",
        word_count(F.col("text")).alias("size"),
        key.cast("long").alias("_key"),
        *([F.struct(*carry).alias("_carried")] if carry else []),
    )
    summed = running_sums(rows, "_source", ["_key", "doc_id", "size"], "size", "mix", "_before")
    sources = summed.groupBy("_source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, max_repeats)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("size"))
    return summed.join(targets, "_source").select(
        "doc_id",
        F.when(F.col("_source") != "1", F.substring("_source", 2, 1 << 30)).alias("source"),
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        *(["_carried"] if carry else []),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document the mix takes.

    Every document gets a key from a hash of its id and ``seed``; rows are range-sorted by key
    within their source, prefix sums of the sizes are taken over all partitions, and each source
    is cut exactly at its target (rounded to whole words): whole epochs first, then the documents
    in key order, of which the last is taken in part.

    Returns ``doc_id, source, size, source_size, target, taken``. Null and empty texts have size 0
    and take 0; a null source is a source of its own, the last; repeated rows are rows of their own;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return _mixed(docs, weights, share, max_repeats, seed, ())


def take_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, with their own columns.

    A document taken twice gives two rows; the one that is cut at its source's budget gives a row
    with the words up to the cut. Documents without words are no training data and take no part.
    """
    columns = docs.columns
    mixed = _mixed(docs, weights, share, max_repeats, seed, tuple(columns))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    repeated = mixed.where(copies > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))
    )
    left, text = F.col("taken") - F.col("_copy") * F.col("size"), F.col("_carried.text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    head = F.array_join(F.slice(words, 1, left.cast("int")), "")
    cut = F.when(left >= F.col("size"), text).otherwise(head)
    return repeated.select(*[cut.alias(c) if c == "text" else F.col(f"_carried.{c}").alias(c) for c in columns])
