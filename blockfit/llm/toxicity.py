"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text, over shared backoff counts.

Levels, from the most special: a word after another (class counts), a word (class continuation
counts: after how many words it occurs), a stem, i.e. the first letters of a word (class counts), and
stem counts over all documents, which both classes share. Absolute discounting links the levels.
Words, stems and pairs live in hashed tables of fixed size, so a model is as large for every corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import WordIds, column_of, hash_bytes, logistic_fit, slices

WORD_BITS, PAIR_BITS, STEM_BITS, STEM_LETTERS, DISCOUNT = 19, 18, 18, 4, 0.9
_LETTERS = re.compile(r"[^\W_]+")
_U = np.uint64


def score_words(text: str | None) -> list[bytes]:
    return " ".join(_LETTERS.findall(text.lower())).encode().split() if text else []


def _derive(words: list[bytes]) -> dict[str, np.ndarray]:
    stems = [w.decode()[:STEM_LETTERS].encode() for w in words]
    return {
        "word": hash_bytes(words, 3) >> _U(20),  # 44 bits
        "stem": (hash_bytes(stems, 4) >> _U(64 - STEM_BITS)).astype(np.int64),
    }


def word_bucket(word: np.ndarray) -> np.ndarray:
    return (word >> _U(44 - WORD_BITS)).astype(np.int64)


def pair_keys(word: np.ndarray) -> np.ndarray:
    """One key per word: the bucket of the word before (0 at the start), then the word's 44 bits."""
    before = np.concatenate([[0], word_bucket(word[:-1])]).astype(_U) if len(word) else np.zeros(0, _U)
    return (before << _U(44)) | word


PRINT_BITS, COUNT_BITS = 23, 20
_FOLD = 0x9E375


def pair_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and fingerprint of pairs, from bits that are hashes already; as ``_pair_slot`` in the JVM."""
    before = keys >> _U(44)
    slot = (keys ^ before * _U(_FOLD)) & _U((1 << PAIR_BITS) - 1)
    mark = ((keys >> _U(PAIR_BITS)) ^ before * _U(_FOLD)) & _U((1 << PRINT_BITS) - 1)
    return slot.astype(np.int64), mark.astype(np.int64)


def _pair_slot(key: Column) -> tuple[Column, Column]:
    spread = F.shiftrightunsigned(key, 44) * F.lit(_FOLD)
    slot = key.bitwiseXOR(spread).bitwiseAND((1 << PAIR_BITS) - 1)
    mark = F.shiftrightunsigned(key, PAIR_BITS).bitwiseXOR(spread).bitwiseAND((1 << PRINT_BITS) - 1)
    return slot, mark


#: ``n`` holds the count in toxic texts in the upper and that in ordinary texts in the lower 32 bits.
#: The key of a stem is its bucket, less 2^63.
_COUNTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
_LOWER = (1 << 32) - 1


def _rows(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> pa.RecordBatch:
    n = (toxic.astype(np.int64) << 32) + ordinary.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=_COUNTS.names)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts: pairs and stems with the counts of either class."""
    words_of = WordIds(_derive)
    for batch in (s for b in batches for s in slices(b)):
        found: tuple[list, list] = [], []
        marks = []
        for text, toxic in zip(column_of(batch, "text"), column_of(batch, "toxic").to_pylist()):
            ids = words_of(score_words(text.as_py()))
            word, stem = words_of.values["word"][ids], words_of.values["stem"][ids]
            found[0].append(pair_keys(word))
            found[1].append(stem.astype(_U) + _U(1 << 63))
            marks.append(np.full(len(ids), bool(toxic)))
        mark = np.concatenate(marks)
        for parts in found:
            keys, at = np.unique(np.concatenate(parts), return_inverse=True)
            toxic = np.bincount(at, mark, len(keys))
            yield _rows(keys, toxic, np.bincount(at, ~mark, len(keys)))
        words_of.fresh()


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all texts: how often each stem occurs; one dense table a task."""
    words_of = WordIds(_derive)
    total = np.zeros(1 << STEM_BITS, np.int64)
    for batch in (s for b in batches for s in slices(b)):
        for text in column_of(batch, "text"):
            ids = words_of(score_words(text.as_py()))
            np.add.at(total, words_of.values["stem"][ids], 1)
        words_of.fresh()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=_COUNTS.names)


@dataclass(frozen=True)
class ToxicityModel:
    """Tables by bucket with two columns, toxic and ordinary."""

    pair_mark: np.ndarray  # fingerprint of the pair that a bucket holds
    pair: np.ndarray  # its discounted probability by class
    pair_count: np.ndarray  # its count in both classes
    pair_rest: np.ndarray  # mass left for the word alone
    word: np.ndarray  # discounted continuation probability of a word
    word_count: np.ndarray  # its count in both classes
    word_rest: np.ndarray  # mass left for its stem
    stem: np.ndarray  # probability of a stem by class, shared counts mixed in
    stem_count: np.ndarray  # its count in both classes

    def __getstate__(self) -> dict:
        # mostly zeros while the corpus is small
        return {k: (zlib.compress(v.tobytes(), 1), v.dtype.str, v.shape) for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        for k, (data, kind, shape) in state.items():
            object.__setattr__(self, k, np.frombuffer(zlib.decompress(data), kind).reshape(shape))

    def ratios(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Log of the toxic over the ordinary probability of each word, and the word before, of a text.

        How a word divides its stem and a pair its word is the same for both classes.
        """
        if not len(word):
            return np.zeros(0)
        keys, here = pair_keys(word), word_bucket(word)
        slot, mark = pair_bucket(keys)
        count = self.word_count[here]
        of_stem = np.where(count > 0, count / np.maximum(self.stem_count[stem], 1), 1.0)
        single = self.word[here] + self.word_rest * self.stem[stem] * of_stem[:, None]
        known = self.pair_mark[slot] == mark
        of_word = np.where(known, self.pair_count[slot] / np.maximum(count, 1), 1.0)
        prob = self.pair[slot] * known[:, None] + self.pair_rest * single * of_word[:, None]
        return np.log(prob[:, 0]) - np.log(prob[:, 1])


@dataclass(frozen=True)
class ToxicityFit:
    """The model, sent to the executors once, and the weights of the calibration."""

    model: Broadcast[ToxicityModel]
    weights: np.ndarray


WINDOW = 8


def features(ratios: np.ndarray) -> tuple[float, float, float]:
    """Length-normalised log-likelihood ratio of the text, and of its best word and window."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0
    width = min(WINDOW, n)
    sums = np.cumsum(np.concatenate([[0.0], ratios]))
    best = float((sums[width:] - sums[:-width]).max()) / width
    return float(sums[-1]) / n, float(ratios.max()), best


def _text_features(docs: DataFrame, shared: Broadcast[ToxicityModel], keep: str) -> DataFrame:
    """The column ``keep`` and the three features of every text, which may be a field of ``keep``."""
    schema = T.StructType(
        [docs.schema[keep], *[T.StructField(c, T.DoubleType()) for c in ("mean_ratio", "best_word", "best_window")]]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordIds(_derive)
        for batch in (s for b in batches for s in _parts(b, keep)):
            got = []
            for text in _texts(batch, keep):
                ids = words_of(score_words(text.as_py()))
                got.append(features(shared.value.ratios(words_of.values["word"][ids], words_of.values["stem"][ids])))
            words_of.fresh()
            columns = [pa.array(c, pa.float64()) for c in zip(*got)]
            yield pa.RecordBatch.from_arrays([column_of(batch, keep), *columns], names=schema.names)

    # a text inside ``keep`` goes to Python once
    sent = [keep] if isinstance(docs.schema[keep].dataType, T.StructType) else [keep, "text"]
    return docs.select(*sent).mapInArrow(measure, schema)


def _texts(batch: pa.RecordBatch, keep: str) -> pa.Array:
    column = column_of(batch, keep)
    return column.field("text") if pa.types.is_struct(column.type) else column_of(batch, "text")


def _parts(batch: pa.RecordBatch, keep: str) -> Iterator[pa.RecordBatch]:
    """Slices with a few MB of text each."""
    sized = pa.RecordBatch.from_arrays([_texts(batch, keep)], names=["text"])
    at = 0
    for part in slices(sized):
        yield batch.slice(at, part.num_rows)
        at += part.num_rows


def _design(mean_ratio, best_word, best_window) -> np.ndarray:
    return np.stack([np.ones_like(mean_ratio), mean_ratio, best_word, best_window], axis=1)


def fit_toxicity(
    docs: DataFrame, labelled: DataFrame, max_labelled: int = 400_000, max_calibration: int = 20_000
) -> ToxicityFit:
    """Learn from ``labelled`` (``doc_id, toxic``, one row a document) and the texts of ``docs``.

    At most ``max_labelled`` labels are used, those with the smallest hash of the id: a bounded
    sample (12 bytes a row), so it is broadcast to the texts, which do not move. A fifth of them by
    hash, at most ``max_calibration``, calibrates the score; the others fill the class counts. The
    shared stem counts are of all ``docs``.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = (
        labelled.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", (F.col("toxic") > 0).alias("toxic"), order.alias("_order"))
        .orderBy("_order", "doc_id")
        .limit(max_labelled)
    )
    calibrates = F.pmod("_order", F.lit(5)) == 0
    texts = docs.select("doc_id", "text")
    marked = texts.join(F.broadcast(chosen.where(~calibrates)), "doc_id").select("text", "toxic")
    counts = marked.mapInArrow(_class_counts, _COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
    shared = docs.select("text").mapInArrow(_shared_counts, _COUNTS).groupBy("key").agg(F.sum("n").alias("n"))

    # every pair counts for its word and, if it occurs twice, for its bucket, where the most frequent
    # one stays (the others are scored by their words); stems are counted as they are
    key, toxic, ordinary = F.col("key"), F.shiftrightunsigned("n", 32), F.col("n").bitwiseAND(_LOWER)
    both, most = toxic + ordinary, F.lit((1 << COUNT_BITS) - 1)
    slot, mark = _pair_slot(key)
    best = F.shiftleft(F.least(both, most), PRINT_BITS + COUNT_BITS - 1) + F.shiftleft(mark, COUNT_BITS - 1)
    best = best + F.floor(F.lit((1 << (COUNT_BITS - 1)) - 1) * toxic / both)
    word = F.shiftrightunsigned(key, 44 - WORD_BITS).bitwiseAND((1 << WORD_BITS) - 1)
    none = F.lit(0).cast("long")

    def entry(level: int, slot: Column, a: Column, b: Column, n: Column, best: Column = none) -> Column:
        named = {"level": F.lit(level), "slot": slot, "a": a, "b": b, "n": n, "best": best}
        return F.struct(*[c.cast("long").alias(k) for k, c in named.items()])

    of_word = entry(0, word, toxic > 0, ordinary > 0, both)
    of_pair = entry(1, slot, none, none, none, best)
    of_stem = entry(2, key.bitwiseAND((1 << STEM_BITS) - 1), toxic, ordinary, both)
    levels = F.when(key < 0, F.array(of_stem)).when(both > 1, F.array(of_word, of_pair)).otherwise(F.array(of_word))
    found = (
        counts.select(F.explode(levels).alias("e"))
        .groupBy("e.level", "e.slot")
        .agg(*[F.sum(f"e.{c}").alias(c) for c in ("a", "b", "n")], F.max("e.best").alias("best"))
        .toArrow()
    )
    column = {c: found.column(c).to_numpy() for c in found.column_names}

    def table(level: int, bits: int, *names: str) -> np.ndarray:
        here = column["level"] == level
        out = np.zeros((1 << bits, len(names)))
        out[column["slot"][here]] = np.stack([column[c][here] for c in names], axis=1)
        return out

    continued, word_count = table(0, WORD_BITS, "a", "b"), table(0, WORD_BITS, "n")
    stem = table(2, STEM_BITS, "a", "b")
    held = np.zeros(1 << PAIR_BITS, np.int64)
    here = column["level"] == 1
    held[column["slot"][here]] = column["best"][here]
    pair_count = (held >> (PRINT_BITS + COUNT_BITS - 1)).astype(float)
    toxic_share = (held & ((1 << (COUNT_BITS - 1)) - 1)) / ((1 << (COUNT_BITS - 1)) - 1)
    pair = np.stack([pair_count * toxic_share, pair_count * (1 - toxic_share)], axis=1)
    everywhere = np.ones(1 << STEM_BITS)
    seen = shared.toArrow()
    everywhere[seen.column("key").to_numpy()] += seen.column("n").to_numpy()
    word_part, word_rest = _discounted(continued)
    stem_part, stem_rest = _discounted(stem)
    totals = np.maximum(stem.sum(axis=0), 1)
    model = ToxicityModel(
        pair_mark=np.where(held > 0, (held >> (COUNT_BITS - 1)) & ((1 << PRINT_BITS) - 1), -1).astype(np.int32),
        pair=(np.maximum(pair - DISCOUNT, 0) / totals).astype(np.float32),
        pair_count=pair_count.astype(np.float32),
        pair_rest=np.maximum(DISCOUNT * continued.sum(axis=0) / totals, 1e-6),
        word=word_part.astype(np.float32),
        word_count=word_count[:, 0].astype(np.float32),
        word_rest=word_rest,
        stem=(stem_part + stem_rest * (everywhere / everywhere.sum())[:, None]).astype(np.float32),
        stem_count=stem.sum(axis=1).astype(np.float32),
    )
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    sample = chosen.where(calibrates).orderBy("_order", "doc_id").limit(max_calibration)
    numbered = texts.join(F.broadcast(sample), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    got = _text_features(numbered, shared_model, "toxic").toArrow()
    values = [got.column(c).to_numpy() for c in got.column_names]
    weights = np.zeros(4)
    if len(values[0]):
        weights = logistic_fit(_design(*values[1:]), values[0].astype(float))
    return ToxicityFit(shared_model, weights)


def _discounted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after absolute discounting, by class, and the mass that this leaves."""
    total = np.maximum(counts.sum(axis=0), 1)
    left = DISCOUNT * (counts > 0).sum(axis=0) / total
    return np.maximum(counts - DISCOUNT, 0) / total, np.maximum(left, 1e-6)


def score_toxicity(
    docs: DataFrame, fit: ToxicityFit, threshold: float = 0.7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, score, predicted`` of every text; with ``carry``, ``score, predicted`` and these
    columns, the text among them, as a struct ``carried``.

    A null text or one without words has the score of a text that says nothing either way. Equal
    rows get equal scores; other columns are ignored; an empty table gives an empty result.
    """
    keep = "carried" if carry else "doc_id"
    source = docs.select(F.struct(*carry).alias("carried")) if carry else docs.select("doc_id", "text")
    found = _text_features(source, fit.model, keep)
    a, b, c, d = (F.lit(float(w)) for w in fit.weights)
    z = a + b * F.col("mean_ratio") + c * F.col("best_word") + d * F.col("best_window")
    return found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).select(
        keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7) -> DataFrame:
    """Fit on the labels of the documents where ``learn`` (of ``doc_id``) holds and score all.

    Several labels of one document count as toxic if one of them is.
    """
    known = labels.where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score_toxicity(docs, fit_toxicity(docs, known), threshold)
