"""Fill-in-the-middle: documents as piece tables, cut, rearranged and put back by descriptors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockfit.llm.common import column_of, slices

TEXT, MARKS = 0, 1
SENTINELS = ("<P>", "<S>", "<M>")
#: Pieces are numbered prefix, middle, suffix and then the marks of prefix, suffix and middle.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
_BLOCK = 1 << 20

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("A") : ord("Z") + 1] = _IS_LETTER[ord("a") : ord("z") + 1] = True


class PieceTable:
    """A byte string as descriptors ``(buffer, start, length)`` over buffers that never change."""

    def __init__(self, buffers: Sequence[bytes], pieces: list[tuple[int, int, int]]):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = pieces

    def cut(self, at: int) -> None:
        """Split the descriptor that holds place ``at``; at an end of one, an empty piece comes in."""
        before = 0
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at <= before + length:
                head = at - before
                self.pieces[k : k + 1] = [(buffer, start, head), (buffer, start + head, length - head)]
                return
            before += length
        raise ValueError("the cut lies behind the end")

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def restored(self, order: Sequence[int]) -> PieceTable:
        """The table that ``arranged(order)`` was made of."""
        return self.arranged(np.argsort(order).tolist())

    def head(self, count: int) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[:count])

    def views(self) -> Iterator[memoryview]:
        return (self.buffers[b][start : start + length] for b, start, length in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.views())


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over UTF-8 bytes: where a unit starts, and where a character starts.

    A unit is a run of ASCII letters or any other character; ``offsets`` are the places where texts start.
    """
    letter = _IS_LETTER[data]
    lead = (data & 0xC0) != 0x80
    starts = lead.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[offsets < len(data)]] = True
    return starts, lead


def place_of(mask: np.ndarray, k: int) -> int:
    """Index of the ``k``-th true value, from 0; the length if there are only ``k``."""
    for at in range(0, len(mask), _BLOCK):
        block = mask[at : at + _BLOCK]
        here = int(np.count_nonzero(block))
        if k < here:
            return at + int(np.flatnonzero(block)[k])
        k -= here
    return len(mask)


def draw(doc_id: object, seed: int) -> list[int]:
    """Four numbers from the SHA-256 of seed and id; a null id counts as an empty string."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def mark_pieces(sentinels: Sequence[bytes]) -> list[tuple[int, int, int]]:
    ends = np.cumsum([len(s) for s in sentinels]).tolist()
    return [(MARKS, end - len(s), len(s)) for s, end in zip(sentinels, ends)]


def opened(output: bytes, form: str, sentinels: Sequence[bytes]) -> PieceTable:
    """The document inside ``output``, from it and its form alone.

    The marks of the form cut the output into pieces and the inverse permutation puts them back. No mark
    occurs in the text of such a form, nor across its end, as a mark starts with a character that comes nowhere
    else in it.
    """
    table = PieceTable((output, b""), [(TEXT, 0, len(output))])
    if form == "plain":
        return table
    order, at = ORDERS[form], 0
    for piece in order[::2]:
        mark = sentinels[piece - 3]
        found = output.index(mark, at)
        if at:
            table.cut(found)
        table.cut(found + len(mark))
        at = found + len(mark)
    return table.restored(order).head(3)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    changed_percent: int = 90,
    spm_percent: int = 20,
    sentinels: Sequence[str] = SENTINELS,
    with_output: bool = False,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` for every row.

    The units of a text are runs of ASCII letters and single other characters; two of their ``n + 1`` borders,
    drawn from ``seed`` and ``doc_id``, cut it into prefix, middle and suffix. ``changed_percent`` of the texts are
    rearranged, of these ``spm_percent`` with the suffix first; the others stay plain. So do empty
    texts and those that hold a sentinel, since they could not be put back. ``restored_sha256`` is that of the text rebuilt from output
    and form alone. ``with_output`` adds ``output`` and ``pieces``, its descriptors ``(buffer, start, length)`` in bytes: buffer 0 is
    the text, buffer 1 the joined sentinels.

    A null text counts as empty (n = 0, plain). A null id draws like an empty one. Equal rows get
    equal results, an empty table none; other columns are ignored.
    """
    if len({s[0] for s in sentinels}) != 1 or any(s[0] in s[1:] for s in sentinels) or len(set(sentinels)) != 3:
        raise ValueError("sentinels: three different strings that share a first character found only there")
    piece = T.StructType(
        [T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output_sha256", T.StringType()),
            T.StructField("restored_sha256", T.StringType()),
            *([T.StructField("output", T.StringType()), T.StructField("pieces", T.ArrayType(piece))] if with_output else []),
        ]
    )
    pieces_type = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pieces_type]
    marks = [s.encode() for s in sentinels]
    joined, mark_at = b"".join(marks), mark_pieces(marks)

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            texts = pa.compute.fill_null(column_of(batch, "text").cast(pa.large_string()), "")
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            blob = texts.buffers()[2]
            raw = memoryview(blob)[ends[0] : ends[-1]] if blob is not None else memoryview(b"")
            ends = ends - ends[0]
            starts, lead = unit_starts(np.frombuffer(raw, np.uint8), ends[:-1])
            rows = []
            for k, doc_id in enumerate(column_of(batch, "doc_id").to_pylist()):
                a, b = int(ends[k]), int(ends[k + 1])
                text, units = bytes(raw[a:b]), starts[a:b]
                n = int(np.count_nonzero(units))
                h = draw(doc_id, seed)
                table = PieceTable((text, joined), [(TEXT, 0, len(text))])
                form, sizes = "plain", (None, None)
                if n and h[2] % 100 < changed_percent and not any(m in text for m in marks):
                    form = "spm" if h[3] % 100 < spm_percent else "psm"
                    first, second = (place_of(units, x) for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    table.cut(first)
                    table.cut(second)
                    sizes = (
                        int(np.count_nonzero(lead[a : a + first])),
                        int(np.count_nonzero(lead[a + first : a + second])),
                    )
                    table.pieces += mark_at
                    table = table.arranged(ORDERS[form])
                output = table.content()
                row = [n, form, *sizes, table.sha256(), opened(output, form, marks).sha256()]
                if with_output:
                    row += [output.decode(), [dict(zip(("buffer", "start", "length"), p)) for p in table.pieces]]
                rows.append(row)
            if rows:
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(rearrange, schema)
