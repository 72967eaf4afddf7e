"""Quality rules: plain counts of a text, and how well public vocabularies fit it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import WordIds, byte_words, column_of, hash_bytes, mixed

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: Words a task knows at once; in check_l a task meets about 440,000 in 20 MB.
WORD_LIMIT = 400_000
_LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")

#: Unicode blocks by first and last letter, for the scripts with bands of their own. Fixed values.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3)),
}


@dataclass(frozen=True)
class Band:
    """A text is rejected outside these limits; entropy is in bits, over the share of log2(n_tokens)."""

    chars_per_token: tuple[float, float]
    fallback_share: float
    entropy_share: float


#: By script. Prose in a language the vocabulary barely knows still has 1.2 characters per token and
#: few fallback bytes; hex strings, base64 and mojibake have less and more. Scripts outside the
#: vocabulary are spelled in bytes, so only their entropy counts.
BANDS = {
    "latin": Band((1.15, 12.0), 0.25, 0.10),
    "greek": Band((0.6, 12.0), 0.60, 0.10),
    "cyrillic": Band((0.8, 12.0), 0.40, 0.10),
    "arabic": Band((0.5, 12.0), 0.70, 0.10),
    "devanagari": Band((0.3, 12.0), 0.95, 0.10),
    "cjk": Band((0.3, 12.0), 0.95, 0.10),
    "other": Band((0.2, 12.0), 1.0, 0.10),
}


def script_of(codes: np.ndarray) -> str:
    """The script with most letters among ``codes``; ``other`` if none is listed."""
    counts = {
        name: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in ranges) for name, ranges in SCRIPTS.items()
    }
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def covered(hashes: np.ndarray, width: int) -> int:
    """Positions inside a window of ``width`` whose hash occurs at two places or more."""
    windows = len(hashes)
    if windows < 2:
        return 0
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(windows, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    steps = np.zeros(windows + width, np.int64)
    at = np.flatnonzero(hit)
    steps[at] += 1
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps)[: windows + width - 1] > 0).sum())


def window_hashes(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One hash for each run of ``len(factors)`` consecutive values."""
    n = len(values) - len(factors) + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k, f in enumerate(factors):
        if n > 0:
            total += values[k : k + n] * f
    return mixed(total)


def odd_factors(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_measures(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: ``doc_id``, the counts of the base rules, script and tokeniser measures.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, ``script``, ``n_tokens``,
    ``chars_per_token``, ``fallback_share``, ``token_entropy`` (bits). ``vocabulary`` is a
    sentencepiece model with byte fallback. A null text counts as empty: all counts 0, script
    ``other``. Every text is measured whole.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            T.StructField("script", T.StringType()),
            T.StructField("n_tokens", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in ("chars_per_token", "fallback_share", "token_entropy")],
        ]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        words_of = WordIds(lambda words: {"h": hash_bytes(words)}, WORD_LIMIT)
        factors = odd_factors(8, 6)
        for batch in batches:
            rows = []
            for value in column_of(batch, "text"):
                text = value.as_py() or ""
                words = byte_words(text)
                ids = words_of(words)
                word_chars = len(text) - sum(map(len, _SPACE.findall(text)))
                repeats = 0
                if len(words) > 8:
                    repeats = covered(window_hashes(words_of.values["h"][ids], factors), 8)
                lines = [x for x in text.split("\n") if _LINE_WORD.search(x)] if "\n" in text else []
                tokens = np.asarray(model.encode(text), dtype=np.int64)
                n = len(tokens)
                counts = np.unique(tokens, return_counts=True)[1]
                shares = counts / max(n, 1)
                rows.append(
                    (
                        len(words),
                        word_chars,
                        len(_SYMBOL.findall(text)),
                        len(lines) - len(set(lines)),
                        repeats,
                        script_of(np.frombuffer(text.encode("utf-32-le"), np.uint32)),
                        n,
                        word_chars / n if n else 0.0,
                        float(is_byte[tokens].mean()) if n else 0.0,
                        float(-(shares * np.log2(shares)).sum()) + 0.0,
                    )
                )
            words_of.fresh()
            columns = [pa.array(x, pa.string() if k == 5 else None) for k, x in enumerate(zip(*rows))]
            if rows:
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(measure, schema)


def fits_band(bands: dict[str, Band] = BANDS):
    """Column: the tokeniser measures lie in the band of the text's script.

    A text of fewer than two tokens has no entropy to judge.
    """
    verdict = F.lit(True)
    for name, band in bands.items():
        low, high = band.chars_per_token
        most = F.log2(F.greatest(F.col("n_tokens"), F.lit(2)))
        inside = (
            F.col("chars_per_token").between(low, high)
            & (F.col("fallback_share") <= band.fallback_share)
            & ((F.col("n_tokens") < 2) | (F.col("token_entropy") >= F.lit(band.entropy_share) * most))
        )
        verdict = F.when(F.col("script") == name, inside).otherwise(verdict)
    return verdict


def quality_rules(
    docs: DataFrame,
    vocabulary: str | None = None,
    bands: dict[str, Band] = BANDS,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or too many of them in repeated 8-word windows.
    ``kept``: not ``base_failed`` and inside the band of the text's script.
    """
    if vocabulary is None:
        from blockfit.llm.packing import tokenizer_path

        vocabulary = tokenizer_path("piece_bpe_32k.model")
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    return (
        text_measures(docs, vocabulary)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & fits_band(bands))
    )


