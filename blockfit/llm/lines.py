"""Substring deduplication by hashing lines: the earliest occurrence of a unit stays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import WORD_PATTERN, column_of, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_unit(unit: Column) -> Column:
    """A-Z in lower case, white space runs as one space, none at the ends."""
    plain = F.regexp_replace(F.translate(unit, UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")
    return F.trim(plain)


def repeated_units(docs: DataFrame, separator: str = "\n", min_words: int = 1) -> DataFrame:
    """``doc_id, text_hash, place``: units whose normal form occurs earlier, by (doc_id, place)."""
    unit = F.posexplode(F.split(F.col("text"), separator.replace("\n", r"\n"), -1)).alias("place", "unit")
    units = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), unit)
    units = units.where(F.regexp_count("unit", F.lit(WORD_PATTERN)) >= min_words)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("order")
    digests = stored(
        units.select("doc_id", order, "text_hash", "place", F.unhex(F.md5(normal_unit(F.col("unit")).cast("binary"))).alias("digest")),
        "units",
    )
    # counted and ordered in one aggregate, partly before the shuffle, so that a hot unit is no hot task
    first = digests.groupBy("digest").agg(
        F.min(F.struct("order", "place")).alias("first"), F.max(F.struct("order", "place")).alias("last")
    )
    # stored, so that the join deals out both sides anew and can split a hot unit
    first = stored(first.where(F.col("first") != F.col("last")).drop("last"), "first-units")
    return (
        digests.join(first, "digest")
        .where(F.struct("order", "place") != F.col("first"))
        .select("order", "text_hash", "place")
    )


def remove_repeated_units(docs: DataFrame, separator: str = "\n", min_words: int = 1) -> DataFrame:
    """Every row without the units that occur earlier: ``doc_id, n_units, n_removed, removed_chars,
    kept, spans``.

    A unit is a line (or what ``separator`` ends, such as an empty line for paragraphs) with at least ``min_words`` words;
    blank ones always stay. Units are equal if they are after lower-casing A-Z and joining white
    space; of equal ones the first by (doc_id, place) stays. ``spans`` holds place, start and
    length of each removed unit in characters of the input text, the separator not included; ``kept``
    is the text without these units and their separators.

    A null text counts as empty, with one empty unit. Rows of equal ``doc_id`` are one document. A null
    id comes last. Other columns are ignored.
    """
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lists = repeated_units(source, separator, min_words)
    lists = lists.groupBy("order", "text_hash").agg(F.collect_set("place").alias("places"))
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("place", "start", "length")])
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *[T.StructField(c, T.LongType()) for c in ("n_units", "n_removed", "removed_chars")],
            T.StructField("kept", T.StringType()),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )
    spans_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("place", "start", "length")]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(column_of(batch, "text"), column_of(batch, "places")):
                units = text.as_py().split(separator)
                gone = set(places.as_py() or ())
                spans, kept, at = [], [], 0
                for place, unit in enumerate(units):
                    if place in gone:
                        spans.append({"place": place, "start": at, "length": len(unit)})
                    else:
                        kept.append(unit)
                    at += len(unit) + len(separator)
                rows.append((len(units), len(spans), sum(s["length"] for s in spans), separator.join(kept), spans))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type)
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *columns], names=schema.names)

    keyed = source.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("order"),
        F.xxhash64("text").alias("text_hash"),
    )
    joined = keyed.join(lists, ["order", "text_hash"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, schema)
