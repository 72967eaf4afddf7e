"""Nearest neighbours by cosine: multi-index hashing of learned rotated binary codes, then exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockfit.llm.common import stored

SUBSTRING_BITS = 8
_VALUES = np.arange(1 << SUBSTRING_BITS, dtype=np.uint8)
_APART = np.bitwise_count(_VALUES[:, None] ^ _VALUES[None, :])


@dataclass(frozen=True)
class CodeModel:
    """Rotations (one per group of bits) and the Hamming radius to search."""

    rotation: np.ndarray  # dimensions x bits
    radius: int

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // SUBSTRING_BITS

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes as bytes, one row a vector; a byte is a substring."""
        return np.packbits(unit @ self.rotation > 0, axis=1)


def valid(column: str) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not all zero."""
    c = F.col(column)
    wrong = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~wrong & F.exists(c, lambda x: x != 0)


def learn_rotation(unit: np.ndarray, groups: int, steps: int, seed: int) -> np.ndarray:
    """Iterative quantisation: rotate the principal axes until signs lose least, from several starts."""
    rng = np.random.default_rng(seed)
    dims = unit.shape[1]
    axes = np.linalg.eigh(unit.T @ unit)[1]
    turned = unit @ axes
    found = []
    for _ in range(groups):
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(steps):
            signs = np.where(turned @ rotation > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ turned)
            rotation = (u @ v).T
        found.append(axes @ rotation)
    whole = np.concatenate(found, axis=1)
    pad = -whole.shape[1] % 64
    if pad:
        whole = np.concatenate([whole, rng.standard_normal((dims, pad))], axis=1)
    return whole


def fit_codes(
    vectors: DataFrame, k: int = 5, groups: int = 4, max_sample: int = 8192, recall: float = 0.985, steps: int = 12, seed: int = 9
) -> CodeModel | None:
    """Fit rotations and radius on at most ``max_sample`` vectors, those with the smallest id hash.

    The radius is the smallest that keeps the share ``recall`` of the sample's own nearest
    neighbours. The whole table is denser than its sample, so its neighbours are nearer and the
    share found there is higher. The dimension is the most frequent one of the sample.
    """
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("vector").toArrow()
    rows = [np.asarray(x, dtype=np.float64) for x in sample.column("vector").to_pylist()]
    if not rows:
        return None
    lengths = np.array([len(x) for x in rows])
    dims = int(np.bincount(lengths).argmax())
    data = np.stack([x for x in rows if len(x) == dims])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    model = CodeModel(learn_rotation(unit, groups, steps, seed), 0)
    bits = model.rotation.shape[1]
    if len(unit) < 64:
        return CodeModel(model.rotation, bits)
    codes = model.encode(unit).view(np.uint64)
    apart = []
    for q in range(0, len(unit), max(1, len(unit) // 512)):
        near = unit @ unit[q]
        near[q] = -2
        best = np.argpartition(-near, k)[:k]
        apart.append(np.bitwise_count(codes[best] ^ codes[q]).sum(axis=1))
    return CodeModel(model.rotation, int(np.ceil(np.quantile(np.concatenate(apart), recall))))


class SubstringIndex:
    """Posting bitmaps of a block of codes: for each substring and value, the codes near that value.

    By the pigeonhole principle a code within ``radius`` of a query is within ``radius // m`` of it in
    one of the first ``radius % m + 1`` of the m substrings, or one less in one of the others.
    """

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = np.ascontiguousarray(codes).view(np.uint64), radius
        m = codes.shape[1]
        near, extra = divmod(radius, m)
        self.postings = [
            np.packbits(_APART[:, codes[:, s]] <= (near if s <= extra else near - 1), axis=1) for s in range(m)
        ]

    def within(self, code: np.ndarray) -> np.ndarray:
        """Positions of all codes within the radius of ``code``."""
        hit = np.bitwise_or.reduce([p[v] for p, v in zip(self.postings, code)])
        at = np.flatnonzero(np.unpackbits(hit, count=len(self.codes)))
        apart = np.bitwise_count(self.codes[at] ^ code.view(np.uint64)).sum(axis=1)
        return at[apart <= self.radius]


def _matrix(table: pa.Table, name: str, dims: int) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    model: CodeModel | None = None,
    block_rows: int = 8192,
    chunk_rows: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query, nearest first.

    Both inputs are ``<vec_id, embedding>``. The rows are dealt into blocks of about ``block_rows`` by
    hash, every block builds its index, and the queries come to it in chunks; each pair of block and
    chunk is one task's work in bounded memory. A query that finds fewer than ``k`` within the
    radius asks again with a larger one, until it has them or all rows.

    Vectors that are null, empty, zero, of another length than the model's, or that hold null or
    non-finite components take no part. Rows with the query's own id are no candidates; several rows
    of one id count once, with the best score. Ties go to the smaller id. Other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("vec_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & valid("embedding")
    shape = lambda df: df.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    rows, asked = shape(vectors), shape(queries).dropDuplicates(["vec_id"])
    model = model or fit_codes(rows, k)
    if model is None:
        return spark.createDataFrame([], T.StructType([schema[0], T.StructField("rank", T.IntegerType()), *schema.fields[1:]]))
    dims, bits = model.rotation.shape
    rows, asked = rows.where(F.size("vector") == dims), asked.where(F.size("vector") == dims)
    total, most = rows.count(), rows.select("vec_id").distinct().count() - 1
    blocks = max(1, -(-total // block_rows))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def search(radius: int):
        def run(index: pa.Table, chunk: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if index.num_rows and chunk.num_rows:
                data, wanted = _matrix(index, "vector", dims), _matrix(chunk, "vector", dims)
                lengths, ids = np.sqrt((data * data).sum(axis=1)), index.column("vec_id").to_numpy()
                found = SubstringIndex(model.encode(data / lengths[:, None]), radius)
                sizes = np.sqrt((wanted * wanted).sum(axis=1))
                codes = model.encode(wanted / sizes[:, None])
                for q, name in enumerate(chunk.column("vec_id").to_pylist()):
                    at = found.within(codes[q])
                    at = at[ids[at] != name]
                    score = (data[at] * wanted[q]).sum(axis=1) / (lengths[at] * sizes[q])
                    # several rows of one id may be among the best
                    best = np.lexsort((ids[at], -score))
                    keep = np.sort(np.unique(ids[at][best], return_index=True)[1])[:k]
                    best = best[keep]
                    out.append((np.full(len(best), name), ids[at][best], score[best]))
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

        return run

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers, radius, open_queries = None, model.radius, asked
    while True:
        chunks = max(1, -(-open_queries.count() // chunk_rows))
        index = rows.withColumn("block", dealt(blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        query = open_queries.withColumn("chunk", dealt(chunks)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        pieces = index.groupBy("block", "chunk").cogroup(query.groupBy("block", "chunk"))
        found = pieces.applyInArrow(search(radius), schema)
        ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        got = stored(ranked.select("query_id", "rank", "vec_id", "score"), "neighbours")
        counts = got.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
        # a query that is no row itself has one candidate more; asking once more settles it
        full = counts.where(F.col("n") >= min(k, max(most, 0))).select("vec_id")
        done = got.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
        answers = done if answers is None else answers.union(done)
        if radius >= bits:
            return answers.union(got.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti"))
        open_queries = stored(open_queries.join(full, "vec_id", "left_anti"), "open-queries")
        if not open_queries.limit(1).count():
            return answers
        radius = min(bits, radius + max(8, radius // 4))
