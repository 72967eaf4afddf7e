"""Language spans: script ranges narrow the candidates, Viterbi over per-word scores does the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import WordIds, column_of, mixed, slices
from blockfit.llm.quality import SCRIPTS, odd_factors

_LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 17
UNDETERMINED = "und"
_SCRIPTS = (*SCRIPTS, "other")
_FACTORS = [odd_factors(n, 100 + n) for n in ORDERS]
#: Viterbi cells (documents x words x languages) held at once.
_CELLS = 8_000_000
#: Words a task knows at once, with five languages or fewer; in check_l a task meets about 440,000 in 20 MB.
WORD_LIMIT = 400_000
_SLICE_BYTES = 4 << 20
#: Numbers of languages on a path.
_STATE = np.int16


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters, lower-cased, as UTF-8."""
    return " ".join(_LETTERS.findall(text.lower())).encode().split() if text else []


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of marked words, and the word each belongs to."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    buckets, owners = [], []
    for n, factors in zip(ORDERS, _FACTORS):
        if len(data) < n:
            continue
        total = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            total += (data[k : len(data) - n + 1 + k] + np.uint64(1)) * factors[k]
        inside = left[: len(total)] >= n
        buckets.append((mixed(total[inside]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[: len(total)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def word_scripts(words: list[bytes]) -> np.ndarray:
    """Script of the first letter of each word that a range lists, as an index into the scripts."""
    first = np.fromiter((ord(w.decode()[0]) for w in words), np.int64, len(words))
    out = np.full(len(words), len(_SCRIPTS) - 1, np.int64)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[(first >= a) & (first <= b)] = k
    return out


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` sorted; log probabilities by (bucket, language); which scripts each one uses."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def fit_languages(docs: DataFrame, smoothing: float = 0.5, script_share: float = 0.01) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of all ``docs`` with a language.

    Tasks count n-gram buckets and scripts by language and the counts are summed by Spark; the
    model has 2^17 buckets a language, whatever the corpus, so it is small enough for the driver.
    """
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())]
    )
    width = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in (s for b in batches for s in slices(b)):
            texts, langs = column_of(batch, "text").to_pylist(), column_of(batch, "lang").to_pylist()
            by_lang: dict[str, dict[bytes, int]] = {}
            for text, lang in zip(texts, langs):
                tally = by_lang.setdefault(lang, {})
                for w in letter_words(text):
                    tally[w] = tally.get(w, 0) + 1
            for lang, tally in by_lang.items():
                words = list(tally)
                times = np.fromiter(tally.values(), np.int64, len(tally))
                row = counts.setdefault(lang, np.zeros(width + len(_SCRIPTS), np.int64))
                buckets, owners = word_grams(words)
                row[:width] += np.bincount(buckets, times[owners], width).astype(np.int64)
                row[width:] += np.bincount(word_scripts(words), times, len(_SCRIPTS)).astype(np.int64)
        for lang, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])],
                names=schema.names,
            )

    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    found = known.mapInArrow(count, schema).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    table = np.zeros((width + len(_SCRIPTS), len(languages)))
    if languages:
        table[found.column("slot").to_numpy(), [languages.index(x) for x in names]] = found.column("n").to_numpy()
    grams, scripts = table[:width], table[width:]
    total = grams.sum(axis=0, keepdims=True)
    scores = np.log((grams + smoothing) / (total + smoothing * width)).astype(np.float32)
    usual = scripts >= script_share * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return LanguageModel(languages, scores, usual)


def best_paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi paths of several texts at once; changing the language costs ``penalty``.

    Texts of like length go through the words together, one array step for each word.
    """
    out: list[np.ndarray] = [np.zeros(0, _STATE)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: -len(scores[k]))
    at = 0
    while at < len(order):
        longest, states = scores[order[at]].shape
        group = order[at : at + max(1, _CELLS // (longest * states))]
        at += len(group)
        lengths = np.array([len(scores[k]) for k in group])
        laid = np.zeros((longest, len(group), states), np.float32)
        for j, k in enumerate(group):
            laid[: lengths[j], j] = scores[k]
        came = np.zeros((longest, len(group), states), _STATE)
        value = laid[0].copy()
        for t in range(1, longest):
            alive = int(np.searchsorted(-lengths, -t))  # texts longer than t come first
            now = value[:alive]
            top = now.argmax(axis=1).astype(_STATE)
            switch = now[np.arange(alive), top][:, None] - penalty
            change = switch > now
            came[t, :alive] = np.where(change, top[:, None], np.arange(states, dtype=_STATE))
            value[:alive] = np.where(change, switch, now) + laid[t, :alive]
        path = np.zeros((longest, len(group)), _STATE)
        state = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            alive = int(np.searchsorted(-lengths, -t))
            path[t, :alive] = state[:alive]
            state[:alive] = came[t, np.arange(alive), state[:alive]]
        for j, k in enumerate(group):
            out[k] = path[: lengths[j], j]
    return out


def label_languages(
    docs: DataFrame, model: LanguageModel, penalty: float = 5.0, with_spans: bool = False
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every text, and with ``with_spans`` the spans of words.

    ``lang_pred`` is the language with most letters on the best path (the first by name among
    equals), ``score`` its share of the letters. A null text, or one without letters, is ``und``
    with score 0; so is everything if nothing was learned. ``spans``: ``(first, last, lang)`` in
    words of letters, from 0. Equal rows get equal results; other columns are ignored.
    """
    span = T.StructType(
        [T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType())]
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            *([T.StructField("spans", T.ArrayType(span))] if with_spans else []),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def derive(words: list[bytes]) -> dict[str, np.ndarray]:
        m = shared.value
        states = len(m.languages)
        score = np.zeros((len(words), states), np.float32)
        if words:
            buckets, owners = word_grams(words)
            for s in range(states):
                score[:, s] = np.bincount(owners, m.scores[buckets, s], len(words)) / len(ORDERS)
            usual = m.scripts[word_scripts(words)]
            score[~usual & usual.any(axis=1, keepdims=True)] -= 1e6
        letters = np.fromiter((len(w.decode()) for w in words), np.int64, len(words))
        return {"score": score, "letters": letters}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.languages
        words_of = WordIds(derive, WORD_LIMIT * 5 // max(5, len(names)))
        for batch in (s for b in batches for s in slices(b, max_bytes=_SLICE_BYTES)):
            ids = [words_of(letter_words(t.as_py())) for t in column_of(batch, "text")]
            scores = [words_of.values["score"][i] for i in ids]
            paths = best_paths(scores, penalty) if names else [np.zeros(0, _STATE)] * len(ids)
            langs, shares, spans = [], [], []
            for i, path in zip(ids, paths):
                if not len(path):
                    langs.append(UNDETERMINED)
                    shares.append(0.0)
                    spans.append([])
                    continue
                mass = np.bincount(path, words_of.values["letters"][i], len(names))
                best = int(mass.argmax())
                langs.append(names[best])
                shares.append(float(mass[best] / mass.sum()))
                if with_spans:
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                    spans.append(
                        [{"first": int(a), "last": int(b) - 1, "lang": names[path[a]]} for a, b in zip(cuts, cuts[1:])]
                    )
            words_of.fresh()
            columns = [column_of(batch, "doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
            if with_spans:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
                columns.append(pa.array(spans, kind))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(label, schema)


def predict_language(docs: DataFrame, learn: Column, penalty: float = 5.0) -> DataFrame:
    """Fit on the rows where ``learn`` holds and label all rows."""
    return label_languages(docs, fit_languages(docs.where(learn)), penalty)
