"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import column_of, stored

_ENCODERS: dict[str, tuple] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """A function from text to ids for a byte-level BPE file of ``tokenizers``.

    The rank file next to it (``.tiktoken``) holds the same vocabulary and gives the same ids about
    four times as fast, so it is used where it exists; a text that names a special token goes
    through ``tokenizers`` itself. One encoder per Python worker.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        full = Tokenizer.from_file(path)
        specials = [t.content for t in full.get_added_tokens_decoder().values()]
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        fast = None
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )
        _ENCODERS[path] = full, fast, specials
    full, fast, specials = _ENCODERS[path]

    def encode(text: str) -> list[int]:
        if fast is None or any(s in text for s in specials):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(
    docs: DataFrame, path: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Documents as pieces of at most ``max_tokens`` ids: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids followed by ``end_id``; a null text counts as empty, so it is that one
    id. Longer documents are cut into full pieces, of which the first takes what does not fill
    one. ``with_ids`` adds the ids, as little-endian unsigned 32-bit numbers.
    """
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            source, piece, start, length, crc, blobs = [], [], [], [], [], []
            for row, text in enumerate(column_of(batch, "text")):
                ids = np.array(encode(text.as_py() or ""), dtype="<u4")
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                n = len(ids)
                first = n - (n - 1) // max_tokens * max_tokens
                at, k = 0, 0
                while at < n:
                    end = first if not k else at + max_tokens
                    blob = ids[at:end].tobytes()
                    source.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(blob))
                    if with_ids:
                        blobs.append(blob)
                    at, k = end, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id").take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    *([pa.array(blobs, pa.binary())] if with_ids else []),
                ],
                names=[f.name for f in fields],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


class OpenBins:
    """At most ``limit`` open bins, found by free space.

    ``lists[f]`` holds the open bins with free space ``f`` and bit ``f`` of ``bits`` says that
    there is one, so the best fit for a piece of ``n`` is the lowest set bit from ``n`` on.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.lists: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def _put(self, number: int, free: int) -> None:
        self.lists[free].append(number)
        self.bits |= 1 << free
        self.open += 1

    def _pop(self, free: int) -> int:
        number = self.lists[free].pop()
        if not self.lists[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of ``n`` tokens."""
        fits = self.bits >> n << n
        if fits:
            free = (fits & -fits).bit_length() - 1
            number = self._pop(free)
        else:
            if self.open >= self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.size
            self.made += 1
        if free > n:
            self._put(number, free - n)
        return number, self.size - free


#: Sequences a packer fills at least, and packers beyond which each gets more instead.
PACKER_SEQUENCES, MOST_PACKERS = 2048, 20_000


def packer_count(tokens: int, max_tokens: int) -> int:
    """How many packers share ``tokens``; the settings of the session have no part in it."""
    return max(1, min(tokens // (PACKER_SEQUENCES * max_tokens), MOST_PACKERS))


def pack(pieces: DataFrame, max_tokens: int = 2048, open_bins: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``max_tokens``.

    Rows are dealt over packers by hash; each packer sees its pieces from long to short and packs
    them online, with ``open_bins`` open bins at most. A packer leaves a few bins unfilled at its end,
    whatever its size, so there are as many as the tokens give at least ``PACKER_SEQUENCES`` full
    sequences to; beyond ``MOST_PACKERS`` each gets more rows, which it sorts on disk. ``pieces`` is read
    twice, for the sum of tokens and for the packing, and is best stored. Sequence numbers are the packer's
    number times 2^33 plus its own count. Equal rows are packed each; an empty table gives no sequence.
    """
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    tokens = pieces.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    n = packer_count(tokens, max_tokens)
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        bins = OpenBins(max_tokens, open_bins)
        for batch in batches:
            placed = [bins.place(x) for x in column_of(batch, "length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([first + b for b, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                names=schema.names,
            )

    dealt = pieces.repartition(n, "doc_id", "piece").sortWithinPartitions(*order)
    return dealt.mapInArrow(fit, schema)


def pack_documents(
    docs: DataFrame, path: str | None = None, max_tokens: int = 2048, open_bins: int = 1024, with_ids: bool = False
) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text), cut long ones, and pack the pieces into sequences."""
    pieces = token_pieces(docs, path or tokenizer_path(), max_tokens, with_ids=with_ids)
    return pack(stored(pieces, "pieces"), max_tokens, open_bins)
