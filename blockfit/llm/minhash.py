"""Near-duplicates by b-bit MinHash: bands propose pairs, packed low bits estimate, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import WordIds, byte_words, column_of, hash_bytes, mixed, shuffle_partitions, slices, stored
from blockfit.llm.graph import connected_components
from blockfit.llm.quality import odd_factors, window_hashes

BANDS, ROWS, LOW_BITS = 40, 6, 4
MINIMA = BANDS * ROWS
PACKED = MINIMA * LOW_BITS // 64
SHINGLE = 5
_U, _W = np.uint64, np.uint32
_FACTORS = {n: odd_factors(n, 50 + n) for n in range(1, SHINGLE + 1)}
_SLOPES = (odd_factors(MINIMA, 7) >> _U(20)).astype(_W) | _W(1)
_SHIFTS = (odd_factors(MINIMA, 8) >> _U(20)).astype(_W)
_BAND_FACTORS = odd_factors(ROWS, 9)
_CHUNK = 4096


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text, from the hashes of its words."""
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, _FACTORS[min(len(hashes), SHINGLE)]))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    folded = (shingles >> _U(32)).astype(_W)
    out = np.full(MINIMA, 0xFFFFFFFF, _W)
    for at in range(0, len(folded), _CHUNK):
        part = folded[at : at + _CHUNK]
        np.minimum(out, ((part[None, :] ^ _SHIFTS[:, None]) * _SLOPES[:, None]).min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    grouped = values.reshape(BANDS, ROWS).astype(_U)
    return mixed((grouped * _BAND_FACTORS).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U))


def packed_bits(values: np.ndarray) -> np.ndarray:
    """The low bits of the minima, after mixing, sixteen to a 64-bit word."""
    low = ((values * _W(0x9E3779B1)) >> _W(32 - LOW_BITS)).astype(_U).reshape(PACKED, 64 // LOW_BITS)
    return (low << (np.arange(64 // LOW_BITS, dtype=_U) * _U(LOW_BITS))).sum(axis=1, dtype=_U)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set), ``bands, bits``; empty sets have no bands."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("bits", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words_of = WordIds(lambda words: {"h": hash_bytes(words)})
        for batch in (s for b in batches for s in slices(b)):
            sizes, digests, bands, bits = [], [], [], []
            for text in column_of(batch, "text"):
                ids = words_of([w.lower() for w in byte_words(text.as_py())])
                found = shingle_set(words_of.values["h"][ids])
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    values = minima(found)
                    bands.append(band_keys(values).view(np.int64))
                    bits.append(packed_bits(values).view(np.int64))
                else:
                    bands.append(np.zeros(0, np.int64))
                    bits.append(np.zeros(0, np.int64))
            words_of.fresh()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, longs),
                    pa.array(bits, longs),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``<node, members>``: the whole set of each document as sorted 64-bit hashes."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("members", T.BinaryType())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordIds(lambda words: {"h": hash_bytes(words)})
        for batch in (s for b in batches for s in slices(b)):
            sets = []
            for text in column_of(batch, "text"):
                ids = words_of([w.lower() for w in byte_words(text.as_py())])
                sets.append(shingle_set(words_of.values["h"][ids]).tobytes())
            words_of.fresh()
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(sets, pa.binary())], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(collect, schema)


def estimate(left: str, right: str) -> Column:
    """Similarity from the share of equal low bits, corrected for equal bits of unequal minima."""
    mask = int("1" * 16, 16)
    differing = []
    for k in range(PACKED):
        x = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing.append(F.bit_count(x.bitwiseAND(mask)))
    equal = F.lit(1.0) - reduce(lambda a, b: a + b, differing) / F.lit(float(MINIMA))
    chance = 2.0**-LOW_BITS
    return (equal - F.lit(chance)) / F.lit(1 - chance)


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of the documents in ``nodes <node>``."""
    ends = nodes.select(F.col("node").alias("doc_id")).distinct()
    return stored(shingle_sets(docs.join(ends, "doc_id", "left_semi")).dropDuplicates(), "sets")


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def linked_pairs(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs <a, b>`` whose full sets are similar enough."""
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("right")), "b"
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(column_of(batch, "left"), column_of(batch, "right")):
                x, y = np.frombuffer(left.as_buffer(), _U), np.frombuffer(right.as_buffer(), _U)
                joint = np.concatenate([x, y])
                joint.sort(kind="stable")
                common = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column_of(batch, c).filter(mask) for c in _LINK.names], names=_LINK.names)

    return both.select("a", "b", "left", "right").mapInArrow(confirm, _LINK)


#: Nodes of a bucket that one task compares with as many others.
BLOCK = 1000
_CELL = ["key", "i", "j"]
_SEAT = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("key", "i", "j", "node", "component")],
        T.StructField("side", T.IntegerType()),
    ]
)


def open_cells(members: DataFrame, components: DataFrame, compared: int) -> DataFrame:
    """Groups ``<key, node>`` that still hold several components, as cells of bounded size.

    A node outside its group's largest component is on the left (1) and every node on the right (2); a
    cell compares a block of the left with a block of the right. Groups of up to ``compared`` nodes
    need no cell.
    """
    placed = members.join(components, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("total")
    )
    blocks = lambda n: F.ceil(n / F.lit(BLOCK))
    split = split.where((F.col("parts") > 1) & (F.col("total") > compared)).select(
        "key",
        F.col("largest.component").alias("largest"),
        blocks(F.col("total") - F.col("largest.n")).alias("lefts"),
        blocks(F.col("total")).alias("rights"),
    )
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    seat = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    across = lambda n, of: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), of)
    left = across(F.col("rights"), lambda j: seat(block(F.col("lefts")), j, 1))
    right = across(F.col("lefts"), lambda i: seat(i, block(F.col("rights")), 2))
    outside = F.col("component") != F.col("largest")
    seats = placed.join(split, "key").withColumn("seat", F.explode(F.when(outside, F.concat(left, right)).otherwise(right)))
    return seats.select("key", "seat.i", "seat.j", "node", "component", "seat.side")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete cells from sorted rows, one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([column_of(batch, c).to_numpy(zero_copy_only=False) for c in _CELL])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if held:
            last = [column_of(held[-1], c)[held[-1].num_rows - 1].as_py() for c in _CELL]
            if last != keys[:, 0].tolist():
                yield pa.concat_batches(held)
                held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _sides(cell: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side, component = (column_of(cell, c).to_numpy(zero_copy_only=False) for c in ("side", "component"))
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2), component


class _Roots(dict):
    """Disjoint sets of numbers, the smallest being the root."""

    def find(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _promising(lowest: float, percent: int):
    """Of every cell the pairs that by packed bits may be similar enough, as edges that connect them."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = 2.0**-LOW_BITS
        most = int((1 - (lowest * (1 - chance) + chance)) * MINIMA) + 1
        ones = _U(int("1" * 16, 16))
        for cell in _cells(batches):
            left, right, component = _sides(cell)
            n, node = (column_of(cell, c).to_numpy(zero_copy_only=False) for c in ("n", "node"))
            bits = column_of(cell, "bits").flatten().to_numpy(zero_copy_only=False).view(_U).reshape(-1, PACKED)
            roots = _Roots()
            for at in range(0, len(left), 128):
                rows = left[at : at + 128]
                apart = np.zeros((len(rows), len(right)), np.int16)
                for k in range(PACKED):
                    x = bits[rows, k][:, None] ^ bits[right, k][None, :]
                    x |= x >> _U(1)
                    x |= x >> _U(2)
                    apart += np.bitwise_count(x & ones)
                a, b = n[rows][:, None], n[right][None, :]
                good = (apart <= most) & (component[rows][:, None] != component[right][None, :])
                good &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                for r in np.flatnonzero(good.any(axis=1)):
                    for other in node[right[good[r]]].tolist():
                        roots.join(int(node[rows[r]]), other)
            out = [(x, roots.find(x)) for x in roots if roots.find(x) != x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_LINK.names)

    return select


def _join_cells(percent: int):
    """Exact intersections of all pairs of a cell; links that join two components."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            left, right, component = _sides(cell)
            node = column_of(cell, "node").to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x.as_buffer(), _U) for x in column_of(cell, "members")]
            sizes = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
            shared = times[shingle] > 1
            column = (np.cumsum(times > 1) - 1)[shingle[shared]]
            owner = owner[shared]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            common = np.zeros((len(left), len(right)), np.float32)
            width = 2048
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                a, b = np.searchsorted(column, (first, first + width))
                part = np.zeros((len(sets), width), np.float32)
                part[owner[a:b], column[a:b] - first] = 1
                common += part[left] @ part[right].T
            union = sizes[left][:, None] + sizes[right][None, :] - common
            good = (100 * common >= percent * union) & (component[left][:, None] != component[right][None, :])
            roots = _Roots()
            out = []
            for r in np.flatnonzero(good.any(axis=1)):
                partners = np.flatnonzero(good[r])
                kinds, at = np.unique(component[right[partners]], return_index=True)
                for kind, k in zip(kinds.tolist(), at):
                    if roots.join(int(component[left[r]]), kind):
                        out.append((int(node[left[r]]), int(node[right[partners[k]]])))
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=_LINK.names)

    return link


def near_duplicates(docs: DataFrame, percent: int = 85, spread: float = 6.0) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents link if 100 * intersection >= ``percent`` * union of their 5-word shingle sets; a
    component is what links reach, named by its smallest id, which is the document kept.

    1. Equal sets are one class, its smallest id the node. 2. 40 bands of 6 minima put nodes into
    buckets (a link at the limit is missed with probability below 1e-8 for 85, below 6e-6 for 80); every node is compared with the smallest
    of each of its buckets. 3. Where a bucket then still holds several components, its nodes outside
    the largest are estimated against all of it, in cells of 1000 by 1000 nodes; nodes connected by such
    pairs form a group, whose full sets are compared in cells of the same size. A cell returns only
    links that join two components. So no partner is capped, no pair is written out, and a bucket of copies
    costs one comparison for each copy. Pairs whose estimate lies ``spread`` standard errors below
    the limit are not compared on full sets.

    Null and empty texts have no shingles and no links. Rows of equal ``doc_id`` are one document.
    A null id links with nothing, has a null component and is kept. Other columns are ignored.
    """
    limit = percent / 100
    hit = limit + (1 - limit) * 2.0**-LOW_BITS
    lowest = limit - spread * (hit * (1 - hit) / MINIMA) ** 0.5 / (1 - 2.0**-LOW_BITS)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(ids), "signatures")
    known = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"),
            F.any_value("n_shingles").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("bits").alias("bits"),
        ),
        "classes",
    )
    rows = classes.select("node", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("_last"))
    heads = heads.where(F.col("head") != F.col("_last")).drop("_last")
    members = stored(rows.join(heads, "key"), "members")
    bits = classes.select("node", "n", "bits")

    def told(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            side = bits.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
            pairs = pairs.join(side, end)
        sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
        return pairs.where(sizes & (estimate("bits_a", "bits_b") >= lowest)).select("a", "b")

    stars = members.where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    checked = stored(told(stars.distinct()).distinct(), "pairs")
    edges = stored(linked_pairs(checked, ids, percent), "links")
    components = connected_components(edges)
    parts = shuffle_partitions(docs.sparkSession)
    dealt = lambda df: df.repartition(parts, *_CELL).sortWithinPartitions(*_CELL)
    # two nodes of a bucket have been compared
    seats = open_cells(members, components, 2).join(bits, "node")
    promising = stored(dealt(seats).mapInArrow(_promising(lowest, percent), _LINK), "promising")
    # nodes that share many buckets meet once, in the group that such pairs connect
    groups = connected_components(promising).withColumnRenamed("component", "key")
    seats = open_cells(groups, components, 1).join(sets_of(groups, ids), "node")
    joined = dealt(seats).mapInArrow(_join_cells(percent), _LINK)
    components = connected_components(stored(edges.union(joined), "links"))
    named = classes.select("digest", "node").join(components, "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("component_id"))
    # rows of one id may lie in several classes: the smallest component of any of them
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNull(), F.lit(None))
            .when(F.col("n_shingles") == 0, F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
