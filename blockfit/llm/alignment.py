"""Two tokenizers side by side: groups of tokens that cover the same bytes, and links between their ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import column_of, slices, stored

#: A single space between other characters than white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of known parts that a task keeps.
_KEPT_BYTES = 160 << 20
#: New parts that are aligned at once, and that are encoded as one text: both tokenizers are fastest on short ones.
_BATCH, _LOT = 4096, 32
#: Pairs of ids that may be broadcast with their counts, about 50 bytes each.
MAX_BROADCAST_PAIRS = 1_000_000


class _Local(dict):
    """A dict that travels to other processes empty: tokenizers lose settings when they are pickled."""

    def __reduce__(self):
        return _Local, ()


_ALIGNERS: dict[tuple[str, str], "Aligner"] = _Local()


def byte_of_letter() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable bytes stand for themselves, the
    others for the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_places(text: str, raw: bytes) -> np.ndarray:
    """Byte offset of each character of ``text`` and of its end."""
    if len(text) == len(raw):
        return np.arange(len(raw) + 1)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.append(np.flatnonzero(lead), len(raw))


def spans_of(offsets: list[list[tuple[int, int]]], before: np.ndarray) -> np.ndarray:
    """The spans of several texts, each moved by the characters before it."""
    sizes = list(map(len, offsets))
    flat = chain.from_iterable(chain.from_iterable(offsets))
    return np.fromiter(flat, np.int64, 2 * sum(sizes)).reshape(-1, 2) + np.repeat(before, sizes)[:, None]


def byte_ends(place: np.ndarray, spans: np.ndarray, lengths: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens of a text end.

    ``spans`` are the character offsets that the tokenizer gives. Where a token ends before the next
    begins, that is a cut, unless it is ``spelled`` (a byte of its own) or its decoded bytes tell
    otherwise. Tokens between two cuts share characters; they end as many bytes behind the cut before them
    as their decoded bytes are long.
    """
    decoded = np.cumsum(lengths)
    first, last = spans[:, 0], spans[:, 1]
    cut = np.append(last[:-1] <= first[1:], True) & ~spelled
    coarse = place[np.minimum(last, len(place) - 1)]
    cut &= coarse == decoded
    before = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
    shift = np.where(before >= 0, coarse[before] - decoded[before], 0)
    return np.where(cut, coarse, decoded + shift)


@dataclass
class Aligned:
    """Of several parts: ``counts`` (whether both tokenizers give the bytes back, tokens of A, of B, groups), the
    ``groups`` written out, and the ``links`` of all, one for each group."""

    counts: np.ndarray
    groups: list[str]
    links: np.ndarray


_NONE = Aligned(np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64))


class Aligner:
    """Both tokenizers with the bytes of their ids; aligns one part of a text at a time."""

    def __init__(self, path_a: str, path_b: str):
        import json
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_of_letter()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [
            bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names
        ]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        self.pairs = len(names) * self.size_b
        self.names = np.array(list(map(str, range(max(len(names), self.size_b)))), dtype=object)
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.spelled_b = np.array([self.b.is_byte(i) for i in range(self.size_b)])
        self.bytes_b = [
            bytes([int(x[3:5], 16)]) if own else x.replace("▁", " ").encode()
            for x, own in zip(pieces, self.spelled_b)
        ]
        self.lengths_a = np.array([len(x) for x in self.bytes_a])
        self.lengths_b = np.array([len(x) for x in self.bytes_b])
        with open(path_a, encoding="utf-8") as lines:
            rules = json.load(lines)
        before = rules.get("pre_tokenizer") or {}
        # A cuts before every space that follows other characters, and no piece of B goes on behind one
        self.by_part = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not rules.get("normalizer")
            and not any(re.search("[^▁]▁", x) for x in pieces)
        )

    def parts(self, text: str) -> list[str]:
        """A space and ``text``, cut where both tokenizers certainly cut: each part stands for a space
        and itself. Tokenizers whose rules do not promise such cuts get whole texts."""
        return _CUT.split(text) if self.by_part else [text]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends, by A and by B, of ``texts`` with a space before each, one after the other; none if
        one of them changes the bytes."""
        from_a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        from_b = self.b.encode(texts, return_type="offset_mapping", num_threads=1)
        whole = " " + " ".join(texts)
        raw, ids = whole.encode(), []
        for found, table in (([x.ids for x in from_a], self.bytes_a), ([x["ids"] for x in from_b], self.bytes_b)):
            ids.append(list(chain.from_iterable(found)))
            if b"".join(map(table.__getitem__, ids[-1])) != raw:
                return None
        ids_a, ids_b, place = np.array(ids[0], np.int64), np.array(ids[1], np.int64), byte_places(whole, raw)
        before = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        spans_a = spans_of([x.offsets for x in from_a], before)
        # B adds the space itself and counts characters without it
        spans_b = spans_of([x["offsets"] for x in from_b], before + 1)
        ends_a = byte_ends(place, spans_a, self.lengths_a[ids_a], np.zeros(len(ids_a), bool))
        ends_b = byte_ends(place, spans_b, self.lengths_b[ids_b], self.spelled_b[ids_b])
        return ids_a, ends_a, ids_b, ends_b

    def written(self, ids: np.ndarray, last: np.ndarray) -> list[str]:
        """The ids of each group, whose last tokens are at ``last``, as decimal numbers with commas."""
        names = self.names[ids].tolist()
        out = self.names[ids[last]].tolist()
        first = np.append(-1, last[:-1]) + 1
        several = np.flatnonzero(first < last)
        for k, x, y in zip(several.tolist(), first[several].tolist(), last[several].tolist()):
            out[k] = ",".join(names[x : y + 1])
        return out

    def align(self, parts: list[str]) -> Iterator[Aligned]:
        """Aligns several parts, joined to short texts, if that leaves each of them what it is."""
        found = self.tokens([" ".join(parts[k : k + _LOT]) for k in range(0, len(parts), _LOT)])
        if found is None:
            if len(parts) == 1:
                yield _NONE
            else:
                for p in parts:
                    yield from self.align([p])
            return
        ids_a, ends_a, ids_b, ends_b = found
        # ends grow from token to token, so each common end belongs to one token of either
        common, to_a, to_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        left, right = self.written(ids_a, to_a), self.written(ids_b, to_b)
        groups = [f"{x}|{y}" for x, y in zip(left, right)]
        last = np.cumsum([1 + len(p.encode()) for p in parts])
        sizes = [np.diff(np.searchsorted(e, last, "right"), prepend=0) for e in (ends_a, ends_b, common)]
        borders = np.concatenate([[0], np.cumsum(sizes[2])]).tolist()
        yield Aligned(
            np.stack([np.ones(len(parts), np.int64), *sizes], axis=1),
            [";".join(groups[x:y]) for x, y in zip(borders, borders[1:])],
            ids_a[to_a] * self.size_b + ids_b[to_b],
        )


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


class PartTable:
    """What was found for the parts a task has met; forgotten once it takes too much."""

    def __init__(self, tool: Aligner):
        self.tool = tool
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((1 << 12, 4), np.int32)
        self.first = np.zeros(1 << 12, np.int64)
        self.links = np.zeros(1 << 12, np.int64)
        self.filled = self.held = 0

    def learn(self, parts: set[str]) -> None:
        """Align new parts. Those without white space at their ends are joined, as the cuts between them are safe."""
        new = [p for p in parts if p not in self.ids]
        joins = [p for p in new if self.tool.by_part and p and p == p.strip() and "▁" not in p]
        for k in range(0, len(joins), _BATCH):
            self._add(joins[k : k + _BATCH])
        for part in set(new).difference(joins):
            self._add([part])

    def _add(self, parts: list[str]) -> None:
        have = len(self.ids)
        self.ids.update(zip(parts, range(have, have + len(parts))))
        for found in self.tool.align(parts):
            have, more, links = len(self.groups), len(found.groups), len(found.links)
            self.groups += found.groups
            self.counts = _room(self.counts, have + more)
            self.first = _room(self.first, have + more)
            self.links = _room(self.links, self.filled + links)
            self.counts[have : have + more] = found.counts
            self.first[have : have + more] = self.filled + np.cumsum(found.counts[:, 3]) - found.counts[:, 3]
            self.links[self.filled : self.filled + links] = found.links
            self.filled += links
            self.held += sum(map(len, found.groups)) + 16 * links
        # strings, a dict entry and the counts cost about 300 bytes besides what they hold
        self.held += sum(300 + len(p) for p in parts)


def _room(values: np.ndarray, need: int) -> np.ndarray:
    """``values`` with room for at least ``need`` rows; doubled, so that growing stays cheap."""
    if len(values) >= need:
        return values
    return np.concatenate([values, np.zeros((2 * need - len(values), *values.shape[1:]), values.dtype)])


def text_links(
    docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False
) -> DataFrame:
    """Per row: ``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and its links, as distinct
    ``pairs`` (``a * size_b + b``) with the ``times`` each occurs; with ``with_groups`` also ``groups``."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("times", T.ArrayType(T.IntegerType())),
            *([T.StructField("groups", T.StringType())] if with_groups else []),
        ]
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        table = PartTable(tool)
        for batch in (s for b in batches for s in slices(b, max_bytes=1 << 20)):
            parts = [tool.parts(t) if t else [] for t in column_of(batch, "text").to_pylist()]
            if table.held > _KEPT_BYTES:
                table.reset()
            table.learn(set(chain.from_iterable(parts)))
            n = len(parts)
            lengths = np.fromiter(map(len, parts), np.int64, n)
            owner = np.repeat(np.arange(n), lengths)
            at = np.fromiter(map(table.ids.__getitem__, chain.from_iterable(parts)), np.int64, len(owner))
            counts = table.counts[at]
            # a text that one of its parts rules out has no tokens
            fits = (np.bincount(owner, 1 - counts[:, 0], n) == 0) & (lengths > 0)
            counts = counts * fits[owner][:, None]
            sums = [np.bincount(owner, counts[:, k], n).astype(np.int64) for k in (1, 2, 3)]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            groups = [
                ";".join(map(table.groups.__getitem__, at[a:b])) if ok else ""
                for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), fits.tolist())
            ]
            shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            # the links of all parts in a row, each with the text it belongs to, counted by text and pair
            size = counts[:, 3]
            place = np.repeat(table.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            keys = np.repeat(owner, size) * tool.pairs + table.links[place]
            keys, times = np.unique(keys, return_counts=True)
            cuts = pa.array(np.searchsorted(keys, np.arange(n + 1) * tool.pairs), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "row"),
                    column_of(batch, "doc_id"),
                    *[pa.array(x, pa.int64()) for x in (*sums, sums[2])],
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(cuts, pa.array(keys % tool.pairs, pa.int64())),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                    *([pa.array(groups, pa.string())] if with_groups else []),
                ],
                names=schema.names,
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(link, schema)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best`` over all links: how many hold the pair, and whether no other pair of its
    B id has more. The ids of A bound the rows of a window."""
    pairs = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = pairs.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count"))
    same_b = Window.partitionBy(F.pmod(F.col("pair"), F.lit(size_b)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(same_b))


def align_tokenizers(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    with_groups: bool = False,
    max_broadcast: int = MAX_BROADCAST_PAIRS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    A is a byte-level vocabulary of ``tokenizers`` and encodes a space and the text, B a ``sentencepiece`` model, which adds
    the space itself. Offsets in bytes at which tokens of both end cut the tokens into groups; the two tokens that
    end there are linked. ``n_best`` counts the links whose pair is the most frequent of its B id over all rows,
    ties included, ``count_sum`` adds up the counts of their pairs. ``with_groups`` adds ``groups``, such as ``a1,a2|b1;a3|b2,b3``.

    The counts are broadcast while there are at most ``max_broadcast`` pairs and joined by shuffle beyond. A text that is null or empty, or
    that either tokenizer changes, has no tokens: zeros and an empty string. Equal rows count each; an empty table gives no rows; other columns are ignored.
    """
    from blockfit.llm.packing import tokenizer_path

    path_a = path_a or tokenizer_path("byte_bpe_50k.json")
    path_b = path_b or tokenizer_path("piece_bpe_32k.model")
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    links = stored(text_links(docs, path_a, path_b, with_groups), "token-links")
    counts = stored(pair_counts(links, size_b), "pair-counts")
    held = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    held = held.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    known = F.broadcast(counts) if counts.count() <= max_broadcast else counts.hint("shuffle_merge")
    sums = (
        held.join(known, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
    )
    none = F.lit(0).cast("long")
    return links.join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
        *(["groups"] if with_groups else []),
    )
