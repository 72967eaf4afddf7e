"""One query per operator over the whole tables of a folder, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfit.llm.alignment import align_tokenizers
from blockfit.llm.common import crc_mod
from blockfit.llm.copies import exact_copies
from blockfit.llm.langid import predict_language
from blockfit.llm.extraction import main_text
from blockfit.llm.infill import fill_in_middle
from blockfit.llm.lines import remove_repeated_units
from blockfit.llm.minhash import near_duplicates
from blockfit.llm.mixing import mix_sources
from blockfit.llm.neighbours import nearest
from blockfit.llm.packing import pack_documents
from blockfit.llm.quality import quality_rules
from blockfit.llm.suffix import remove_repeats
from blockfit.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    found = predict_language(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_minhash_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query
def op3_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    found = toxicity(docs, labels, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op4_source_mix(spark, sf):
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '#mix'), 1, 15) AS BIGINT) AS rank_key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
         1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM s
), level AS (
  SELECT max((wanted - cap_before) / weight_from) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, level * weight) AS target FROM o, level
), c AS (
  SELECT d.doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM c
"""


@query
def op6_quality_rules(spark, sf):
    return quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op8_best_fit_packing(spark, sf):
    return pack_documents(table(spark, sf, "documents"))


@query
def op10_suffix_dedup(spark, sf):
    found = remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_nearest_neighbours(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op5_html_text(spark, sf):
    return main_text(table(spark, sf, "pages"))


@query
def op7_line_dedup(spark, sf):
    found = remove_repeated_units(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("kept").alias("text"), "n_removed", "removed_chars", "n_units")


ORACLES["op7_line_dedup"] = r"""
WITH u AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS units FROM documents
), e AS (
  SELECT doc_id, unnest(units) AS unit, unnest(range(len(units))) AS place FROM u
), n AS (
  SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain,
         regexp_matches(unit, '[^\x20\x09-\x0D]') AS counted
  FROM e
), r AS (
  SELECT *, counted AND row_number() OVER (PARTITION BY counted, plain ORDER BY doc_id, place) > 1 AS gone FROM n
)
SELECT doc_id, coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
       CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
       CAST(sum(CASE WHEN gone THEN length(unit) ELSE 0 END) AS BIGINT) AS removed_chars, count(*) AS n_units
FROM r GROUP BY doc_id
"""


@query
def op11_exact_dedup(spark, sf):
    return exact_copies(table(spark, sf, "documents"))


ORACLES["op11_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op12_token_alignment(spark, sf):
    return align_tokenizers(table(spark, sf, "documents"))


@query
def op13_fill_in_middle(spark, sf):
    return fill_in_middle(table(spark, sf, "documents"))


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
         least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
