"""Substring deduplication by blockwise suffix sorting over a cover sample.

A suffix counts with its first ``length`` bytes only. The cover sample: of the grams inside a
window of ``length`` bytes the one with the smallest hash is the window's sample position, so two
equal windows are sampled at the same place, whatever stands around them (the covering property; a
cover of fixed offsets samples one position in seven, this one in thirty-five). Neighbouring windows
with one sample position form a segment.

1. Rank the sample: segments are named by (gram, hash of the whole segment). Equal names settle ties
   of any length at once: all suffixes of the later segment repeat.
2. What is left are suffixes in segments whose gram also occurs in a different segment, at the ends of
   repeated passages. They form suffix buckets, one for each gram; a task sorts one block of
   buckets at a time in the order of their bytes and compares neighbours.
3. A gram whose different segments in the whole corpus make more than one block (the end of a passage that
   many documents share) is no bucket: its suffixes are grouped one by one, pre-aggregated.

All steps hold one block of rows at a time, whatever the size of a text, a bucket or a group: the segments of
a gram stream past, and beyond a block of different ones nothing but the last is kept. A slice of text sends at
most ``HOT_HERE`` segments of one gram to the task that ranks it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import column_of, mixed, shuffle_partitions, slices, stored
from blockfit.llm.quality import odd_factors

_U = np.uint64
GRAM = 32
#: Longest string, as suffixes are spelled out; shorter ones than a gram have no sample.
MOST_LENGTH = 1024
BUFFER = 1 << 19  # bytes looked at together
#: Different segments of a gram in one slice of texts beyond which it is hot, whatever the others hold.
HOT_HERE = 64
#: Rows that a task looks at together at least before it decides on the grams among them.
ROWS = 1 << 16
_POSITION = _U((1 << 22) - 1)
#: Kinds of rows; ``DONE`` is a segment of a hot gram that has been passed on.
SEGMENT, MARKER, REPEAT, BUCKET, SINGLE, DONE = range(6)
_BYTES = odd_factors(256, 31)
_BYTES2 = odd_factors(256, 32)
_STEPS = odd_factors(6, 33)
_BASE = int(odd_factors(1, 34)[0])
_TABLES: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for hashes of any slice."""
    if not _TABLES:
        n = BUFFER + 4096
        up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _TABLES["up"], _TABLES["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _TABLES["up"], _TABLES["down"]


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Buffers of (row, offset, bytes); long texts are cut so that every window lies in one piece."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            part = text[at : at + BUFFER // 2 + length - 1]
            if size + len(part) > BUFFER:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
            at += BUFFER // 2
    if held:
        yield held


def segments(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Segments of all texts: ``row, start, count`` (of windows), ``gram`` and ``name`` hashes."""
    window = length - GRAM + 1
    up, down = _powers()
    parts: list[tuple[np.ndarray, ...]] = []
    for held in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        begins = np.cumsum(sizes) - sizes
        gram = _BYTES[data]
        for k, step in zip((1, 2, 4, 8, 16), _STEPS):
            gram = gram[:-k] * step + gram[k:]
        gram = mixed(gram)
        low = (gram & ~_POSITION) | np.arange(len(gram), dtype=_U)
        reach = 1
        while 2 * reach <= window:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if window > reach:
            low = np.minimum(low[: len(low) - (window - reach)], low[window - reach :])
        sample = (low & _POSITION).astype(np.int64)  # by window start
        valid = np.ones(len(sample), bool)
        for begin, size in zip(begins[1:], sizes):
            valid[begin - length + 1 : begin] = False
        at = np.flatnonzero(valid)
        anchor = sample[at]
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        first = at[cut]
        last = at[np.concatenate([cut[1:], [len(at)]]) - 1]
        prefix = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES2[data] * up[: len(data)])])
        count = last - first + 1
        name = (prefix[last + length] - prefix[first]) * down[first] + count.astype(_U) * _STEPS[5]
        piece = np.searchsorted(begins, first, side="right") - 1
        rows = np.array([r for r, _, _ in held])[piece]
        offsets = np.array([o for _, o, _ in held])[piece]
        parts.append((rows, first - begins[piece] + offsets, count, gram[anchor[cut]], mixed(name)))
    if not parts:
        none = np.zeros(0, np.int64)
        parts = [(none, none, none, none.astype(_U), none.astype(_U))]
    return dict(zip(("row", "start", "count", "gram", "name"), map(np.concatenate, zip(*parts))))


#: ``place`` holds start (31 bits, as a value has no more bytes), tag of the text (16), number of windows (13)
#: and kind (3).
_START, _TAG, _COUNT = 32, 16, 3
_TAGS, _MOST_COUNT = 0xFFFF, (1 << 13) - 1


def _place(start, tag, count, kind) -> np.ndarray:
    return (start << _START) | (tag << _TAG) | (count << _COUNT) | kind


def _unplace(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> _START, (place >> _TAG) & _TAGS, (place >> _COUNT) & _MOST_COUNT, place & 7


_RECORD = T.StructType([T.StructField(c, T.LongType()) for c in ("gram", "name", "rank", "place")])


def _record(gram, name, rank, place) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, name, rank, place)]
    return pa.RecordBatch.from_arrays(arrays, names=_RECORD.names)


def text_tag(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data) & _TAGS


def _binary(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in column_of(batch, "data").to_pylist()]


def _name_segments(length: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "data"):
                texts = _binary(batch)
                rank = column_of(batch, "rank").to_numpy(zero_copy_only=False)
                tags = np.array([text_tag(t) for t in texts], np.int64)
                s = segments(texts, length)
                order = np.lexsort((s["start"], rank[s["row"]], s["name"], s["gram"]))
                gram, title, start, count = (s[c][order] for c in ("gram", "name", "start", "count"))
                row = s["row"][order]
                owner, tag = rank[row], tags[row]
                if not len(gram):
                    continue
                lead = np.concatenate([[True], (gram[1:] != gram[:-1]) | (title[1:] != title[:-1])])
                head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
                later = (owner != owner[head]) | (start != start[head])
                yield from _repeats(owner[later], tag[later], start[later], start[later] + count[later])
                gram, title, owner, tag, start, count = (x[lead] for x in (gram, title, owner, tag, start, count))
                fresh = np.concatenate([[True], gram[1:] != gram[:-1]])
                group = np.cumsum(fresh) - 1
                hot = np.bincount(group)[group] > HOT_HERE
                plain = ~hot
                yield _record(
                    gram[plain], title[plain], owner[plain], _place(start[plain], tag[plain], count[plain], SEGMENT)
                )
                if hot.any():
                    spread = mixed(owner[hot].astype(_U))
                    yield _record(spread, title[hot], owner[hot], _place(start[hot], tag[hot], count[hot], SINGLE))
                    marked = gram[hot & fresh]
                    none = np.zeros(len(marked), np.int64)
                    yield _record(marked, none, none, none + MARKER)

    return name


def _repeats(owner, tag, start, end) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated window starts, neighbours joined; ``name`` is the end."""
    if not len(owner):
        return
    order = np.lexsort((start, tag, owner))
    owner, tag, start, end = owner[order], tag[order], start[order], end[order]
    same = (owner[1:] == owner[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] <= end[:-1])
    first = np.concatenate([[True], ~same])
    last = np.concatenate([~same, [True]])
    place = _place(start[first], tag[first], 0, REPEAT)
    yield _record(mixed(owner[first].astype(_U)), end[last], owner[first], place)


def _block_rows(length: int) -> int:
    """Segments whose suffixes are spelled out together, some 10 MB; a gram with more of them is hot."""
    return max(1, 15_000_000 // length**2)


def _rank_segments(most: int):
    """From rows sorted by (gram, name, rank, place), one gram after the other: which repeat, and which
    have to be compared suffix by suffix; a bucket has ``most`` different segments at most."""

    def decide(rows: np.ndarray, more: bool = False):
        """Yields the decisions; with ``more``, the rows are of one gram that goes on, and what has to be
        kept of it, a bounded number of rows, is returned."""
        kind = rows[3] & 7
        passed = (kind == REPEAT) | (kind == SINGLE)
        if passed.any():
            yield _record(*rows[:, passed])
        rows = rows[:, ~passed]
        gram, name, rank, place = rows
        if not len(gram):
            return rows
        start, tag, count, kind = _unplace(place)
        marker = kind == MARKER
        fresh = np.concatenate([[True], gram[1:] != gram[:-1]])
        group = np.cumsum(fresh) - 1
        lead = fresh | np.concatenate([[True], (name[1:] != name[:-1])]) | marker
        lead[1:] |= marker[:-1]
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = ~marker & ((rank != rank[head]) | (start != start[head]))
        yield from _repeats(rank[later], tag[later], start[later], start[later] + count[later])
        first = lead & (kind == SEGMENT)
        different = np.bincount(group, first)[group]
        hot = (different > most) | (np.bincount(group, marker | (kind == DONE))[group] > 0)
        if more and not hot[0]:
            return rows[:, first]
        for rule, where in ((BUCKET, first & (different > 1) & ~hot), (SINGLE, first & hot)):
            if where.any():
                yield _record(gram[where], name[where], rank[where], _place(start[where], tag[where], count[where], rule))
        if not more:
            return None
        kept = rows[:, lead & ~marker][:, -1:].copy()  # the next rows may have its name
        kept[3] = kept[3] & ~np.int64(7) | DONE
        mark = np.array([[gram[0]], [0], [0], [MARKER]], np.int64)
        return np.concatenate([mark, kept], axis=1)

    def rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([column_of(batch, c).to_numpy(zero_copy_only=False) for c in _RECORD.names]))
            if sum(x.shape[1] for x in held) >= ROWS:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last gram may go on
                if whole:
                    yield from decide(rows[:, :whole])
                    held = [rows[:, whole:]]
                else:
                    held = [(yield from decide(rows, more=True))]
        if held:
            yield from decide(np.concatenate(held, axis=1))

    return rank_all


def _suffixes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """All suffixes of the given slices as rows of ``length`` bytes, with rank, tag and start."""
    start, tag, count, _ = _unplace(column_of(batch, "place").to_numpy(zero_copy_only=False))
    data = np.frombuffer(b"".join(column_of(batch, "slice").to_pylist()), np.uint8)
    begins = np.cumsum(count + length - 1) - (count + length - 1)
    of = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    rows = np.lib.stride_tricks.sliding_window_view(data, length)[begins[of] + step]
    rank = column_of(batch, "rank").to_numpy(zero_copy_only=False)
    return rows, rank[of], tag[of], start[of] + step


def _fingerprints(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every suffix."""
    length = rows.shape[1]
    out = []
    for seed in (35, 36):
        factors = odd_factors(length, seed)
        total = np.zeros(len(rows), _U)
        for k in range(length):
            total += _BYTES[rows[:, k]] * factors[k]
        out.append(mixed(total))
    return out[0], out[1]


def _sort_buckets(length: int):
    """Sort the suffixes of complete buckets, a block at a time; equal neighbours repeat."""
    room = _block_rows(length)

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, rank, tag, start = _suffixes(batch, length)
        pad = -length % 8
        words = np.pad(rows, ((0, 0), (0, pad))).view(">u8").astype(_U)
        order = np.lexsort((start, rank, *words.T[::-1]))
        words, rank, tag, start = words[order], rank[order], tag[order], start[order]
        lead = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = (rank != rank[head]) | (start != start[head])
        yield from _repeats(rank[later], tag[later], start[later], start[later] + 1)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, room):
                part = batch.slice(at, room)
                held = part if held is None else pa.concat_batches([held, part])
                grams = column_of(held, "gram").to_numpy(zero_copy_only=False)
                if len(grams) >= room:
                    whole = int(np.searchsorted(grams, grams[-1]))
                    if whole:
                        yield from block(held.slice(0, whole))
                        held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from block(held)

    return sort


def _single_suffixes(length: int):
    """Fingerprints of single suffixes; of equal ones in a block only the first is left to compare."""
    room = _block_rows(length)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, room):
                rows, rank, tag, start = _suffixes(batch.slice(at, room), length)
                one, two = _fingerprints(rows)
                order = np.lexsort((start, rank, two, one))
                one, two, rank, tag, start = (x[order] for x in (one, two, rank, tag, start))
                lead = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
                later = (rank != rank[head]) | (start != start[head])
                yield from _repeats(rank[later], tag[later], start[later], start[later] + 1)
                left = ~later
                yield _record(one[left], two[left], rank[left], _place(start[left], tag[left], 1, SINGLE))

    return each


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """``rank, tag, first, last``: window starts (``last`` excluded) that also occur earlier.

    ``docs`` has ``rank`` (long, the order of documents) and ``data`` (binary).
    """
    if not GRAM <= length <= MOST_LENGTH:
        raise ValueError(f"length must be from {GRAM} to {MOST_LENGTH} bytes, not {length}")
    n = shuffle_partitions(docs.sparkSession)
    names = docs.select("rank", "data").mapInArrow(_name_segments(length), _RECORD)
    sorted_names = names.repartition(n, "gram").sortWithinPartitions("gram", "name", "rank", "place")
    ranked = stored(sorted_names.mapInArrow(_rank_segments(_block_rows(length)), _RECORD), "ranked")
    kind, start = F.col("place").bitwiseAND(7), F.shiftright("place", _START)
    count = F.shiftright("place", _COUNT).bitwiseAND(_MOST_COUNT)
    asked = ranked.where(kind.isin(BUCKET, SINGLE)).select("gram", "rank", "place", _tag().alias("tag"))
    texts = docs.select("rank", "data", "tag")
    cut = F.substring(F.col("data"), (start + 1).cast("int"), (count + (length - 1)).cast("int"))
    slices = stored(
        asked.join(texts, ["rank", "tag"]).select("gram", "rank", "place", cut.alias("slice")), "slices"
    )
    # rows of one document given twice ask twice
    slices = slices.dropDuplicates(["gram", "rank", "place"])
    buckets = slices.where(kind == BUCKET).repartition(n, "gram").sortWithinPartitions("gram", "rank", "place")
    found = buckets.mapInArrow(_sort_buckets(length), _RECORD)
    grouped = stored(slices.where(kind == SINGLE).mapInArrow(_single_suffixes(length), _RECORD), "singles")
    singles = grouped.where(kind == SINGLE)
    earliest = singles.groupBy("gram", "name").agg(F.min(F.struct("rank", start.alias("start"))).alias("head"))
    later = singles.join(earliest, ["gram", "name"]).where(
        (F.col("rank") != F.col("head.rank")) | (start != F.col("head.start"))
    )
    whole = [F.col("rank"), _tag().alias("tag"), start.alias("first")]
    return (
        ranked.where(kind == REPEAT)
        .select(*whole, F.col("name").alias("last"))
        .union(grouped.where(kind == REPEAT).select(*whole, F.col("name").alias("last")))
        .union(found.select(*whole, F.col("name").alias("last")))
        .union(later.select(*whole, (start + 1).alias("last")))
    )


def _tag() -> Column:
    return F.shiftright("place", _TAG).bitwiseAND(_TAGS)


def remove_repeats(
    docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), with_text: bool = False
) -> DataFrame:
    """Every row with the bytes removed that a repeated string of ``length`` bytes covers.

    A string is repeated if it also starts earlier: in a document of smaller ``doc_id``, or before
    in the same one; ``length`` is from 32 to 1024, else an error. Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed
    ranges as byte offsets of the input), ``kept`` (the remaining bytes) and ``carry``; or, with
    ``with_text``, the remaining ``text`` instead of ``kept``, without characters cut in the middle.

    A null text counts as empty; texts shorter than ``length`` lose nothing. Rows with the same
    ``doc_id`` are one document and do not repeat each other; a null id comes after all others. Extra
    columns are ignored unless named in ``carry``.
    """
    source = docs.select(
        *docs.select("doc_id").columns,
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        F.struct(*carry).alias("carried") if carry else F.lit(None).cast("struct<none:int>").alias("carried"),
    )
    tagged_schema = T.StructType([*source.schema.fields, T.StructField("tag", T.LongType())])

    def add_tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "data")):
            tags = pa.array([text_tag(t) for t in _binary(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tags], names=tagged_schema.names)

    tagged = source.mapInArrow(add_tag, tagged_schema)
    ranges = repeated_ranges(tagged.select("rank", "data", "tag"), length)
    lists = ranges.groupBy("rank", "tag").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    carried = [docs.schema[c] for c in carry if c != "doc_id"]
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("text", T.StringType()) if with_text else T.StructField("kept", T.BinaryType()),
        ]
    )
    extra = T.StructType([*schema.fields, T.StructField("carried", source.schema["carried"].dataType)])

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "data")):
            rows = []
            for data, ranges in zip(_binary(batch), column_of(batch, "ranges")):
                spans = _merged(ranges, length, len(data))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append(
                    (
                        len(data),
                        len(data) - len(left),
                        len(spans),
                        hashlib.sha256(left).hexdigest(),
                        [{"start": a, "end": b} for a, b in spans],
                        left.decode("utf-8", "ignore") if with_text else left,
                    )
                )
            kinds = [pa.int64()] * 3 + [pa.string(), spans_type, pa.string() if with_text else pa.binary()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id"), *columns, column_of(batch, "carried")], names=extra.names
                )

    joined = tagged.join(lists, ["rank", "tag"], "left").select("doc_id", "data", "ranges", "carried")
    done = joined.mapInArrow(cut, extra)
    return done.select(*schema.names, *[F.col("carried")[f.name].alias(f.name) for f in carried])


def _merged(ranges: pa.Scalar, length: int, size: int) -> list[tuple[int, int]]:
    """Bytes covered by windows that start in the ranges, as maximal runs."""
    if not ranges.is_valid:
        return []
    values = ranges.values
    first = values.field("first").to_numpy(zero_copy_only=False)
    last = values.field("last").to_numpy(zero_copy_only=False) - 1 + length
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.minimum(np.maximum.accumulate(last[order]), size)
    breaks = np.flatnonzero(first[1:] > last[:-1])
    begins = first[np.concatenate([[0], breaks + 1])]
    ends = last[np.concatenate([breaks, [len(last) - 1]])]
    return [(int(a), int(b)) for a, b in zip(begins, ends)]
