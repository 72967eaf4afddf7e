"""A training corpus from ``documents``: filter, deduplicate twice, mix, pack.

Each stage works on all rows that the one before it kept and returns the columns of ``documents``; the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockfit.llm.common import stored
from blockfit.llm.minhash import near_duplicates
from blockfit.llm.mixing import take_mix
from blockfit.llm.packing import pack_documents
from blockfit.llm.suffix import remove_repeats
from blockfit.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on all labels of the folder; documents with a score of 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), carry=COLUMNS)
    return scored.where(F.col("predicted") == 0).select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, a similarity of 0.8 or more) stays,
    the one with the smallest id.

    Of equal rows one stays.
    """
    gone = near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    # the join leaves the rows of an id together, so dropping equal ones needs no further shuffle
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes stays where it starts first; texts that this empties go."""
    cut = remove_repeats(docs, carry=("lang", "source"), with_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's budget is cut there."""
    mixed = take_mix(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids; one row for each piece of a document."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("suffix array", drop_repeated_strings),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: The models, hashes and tokenizer of the stages are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
