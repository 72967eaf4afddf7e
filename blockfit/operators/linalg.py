"""Distributed linear-algebra aggregates over rows, chunks and block tables.

Statistics of few features are plain SQL sums; above that a kernel adds up dense
chunks per partition and Spark adds the partial results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfit.functions.arrays import class_margins, collect_sum, dot, row_softmax, whole_vector
from blockfit.operators.blocks import chunk_matrices, feature_matrix, spread_blocks
from blockfit.operators.trees import partition_bound, tree_levels, tree_sum
from blockfit.plans.kernels import scaled_inverse, softmax_terms

# up to here statistics are plain sums over columns
SMALL_WIDTH = 8
# partial results of one job that may reach the driver, in bytes
PARTIALS_LIMIT = 64 << 20
# partial Gram matrices a task keeps before it hands them on, in bytes
_HELD_LIMIT = 256 << 20

# statistics of all blocks up to this size are summed where the rows are, in bytes
_IN_PLACE_LIMIT = 32 << 20

_DOUBLES = pa.list_(pa.float64())


def vector_sum(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    fan_in: int | None = None,
    width: int | None = None,
    num_partials: int | None = None,
    num_groups: int = 1,
) -> DataFrame:
    """Element-wise sum of a vector column per group, with partial sums before every shuffle.

    The partial sums of the partitions meet in a tree (:func:`blockfit.operators.trees.tree_sum`), planned from
    ``width`` and ``num_partials``, so that no task reads more than a set number of bytes at any width.
    ``fan_in`` puts a level in front that adds up the rows of so many partitions.
    """
    if fan_in:
        salted = df.withColumn("_salt", F.floor(F.spark_partition_id() / F.lit(fan_in)))
        df = salted.groupBy(*by, "_salt").agg(collect_sum(col).alias(col))
    return tree_sum(df, col, by, width, num_partials, num_groups)


def driver_sum(partials: DataFrame, num_partials: int, widths: dict[str, int]) -> dict[str, np.ndarray]:
    """Sum of partial vectors on the driver.

    ``partials`` has the columns of ``widths`` (vector name to length). While all partials
    together stay below a limit they are fetched as they are and added in order, which
    takes one stage; else Spark adds them in a tree first, however many partitions the session has.
    """
    names = list(widths)
    if num_partials * sum(widths.values()) * 8 > PARTIALS_LIMIT:
        joined = partials.select(F.concat(*names).alias("all"))
        total = np.asarray(vector_sum(joined, "all", (), None, sum(widths.values()), num_partials).first()["all"])
        cuts = np.cumsum([widths[n] for n in names])[:-1]
        return dict(zip(names, np.split(total, cuts)))
    table = partials.select(*names).toArrow()
    out = {}
    for name in names:
        total = np.zeros(widths[name])
        for value in table[name]:
            total += np.asarray(value.values)
        out[name] = total
    return out


def _tree_agg(df: DataFrame, by: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    """``sums`` per group, with levels in between where the partitions have more sums than a task should read."""
    bound = partition_bound(df)
    levels = tree_levels(bound, 8 * len(sums))
    if not levels:
        return df.groupBy(*by).agg(*sums)
    salted = df.withColumn("_place", F.floor(F.spark_partition_id() * F.lit(levels[0] / bound)).cast("int"))
    table = salted.groupBy(*by, "_place").agg(*sums)
    names = [c for c in table.columns if c not in (*by, "_place")]
    return table.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def _triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def with_label(df: DataFrame) -> DataFrame:
    """The rows that count in statistics: those with a label. Their features must be whole."""
    return df.filter(F.col("label").isNotNull())


def whole_rows(features: pa.Array, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, and which rows are whole; rows with nulls are zeros, ragged ones an error.

    The same rule as that of ``whole_vector`` in SQL.
    """
    X = np.zeros((len(features), p))
    known = features.is_valid().to_numpy(zero_copy_only=False)
    lengths = pa.compute.list_value_length(features).fill_null(p).to_numpy(zero_copy_only=False)
    if (lengths != p).any():
        raise ValueError(f"rows differ in their number of features: {p} expected")
    values = features.flatten()
    X[known] = values.to_numpy(zero_copy_only=False).reshape(-1, p)
    holes = np.zeros(X.shape, bool)
    holes[known] = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, p)
    broken = holes.any(axis=1)
    X[broken] = 0
    return X, known & ~broken


def row_gram(df: DataFrame, p: int) -> DataFrame:
    """Gram statistics of unpacked rows per ``block_id`` as plain SQL sums, for few features."""
    df = df.select("block_id", "label", whole_vector("features", p, "raise").alias("features"))
    x, y = F.col("features"), F.col("label")
    sums = [F.sum(x[i] * x[j]).alias(f"_g{i}_{j}") for i, j in _triangle(p)]
    sums += [F.sum(x[i] * y).alias(f"_c{i}") for i in range(p)]
    sums = [F.count("*").alias("n"), F.sum(y * y).alias("yy"), *sums]
    table = _tree_agg(df, ["block_id"], sums)
    gram = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    cross = F.array(*[F.col(f"_c{i}") for i in range(p)])
    return table.select(
        F.col("block_id").cast("long").alias("block_id"), "n", gram.alias("gram"), cross.alias("cross"), "yy"
    )


def _chunk_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    blocks = batch.column("block_id")
    for i, X, y in chunk_matrices(batch):
        yield blocks[i].as_py(), X, y


def _row_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if batch.num_rows == 0:
        return
    X, y = feature_matrix(batch), np.asarray(batch.column("label"))
    blocks = np.asarray(batch.column("block_id"))
    if (blocks == blocks[0]).all():
        yield int(blocks[0]), X, y
        return
    order = np.argsort(blocks, kind="stable")
    edges = np.flatnonzero(np.diff(blocks[order])) + 1
    for rows in np.split(order, edges):
        yield int(blocks[rows[0]]), X[rows], y[rows]


def _gram_partials(parts_of: Callable) -> Callable:
    """Kernel: per partition and block ``[n, yy, cross.., gram..]``; few are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out():
            blocks = sorted(held)
            stacked = [np.concatenate([[held[b][0], held[b][3]], held[b][2], held[b][1].ravel()]) for b in blocks]
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(stacked, _DOUBLES)], names=["block_id", "s"]
            )

        for batch in batches:
            for b, X, y in parts_of(batch):
                if b not in held:
                    if held and (len(held) + 1) * X.shape[1] ** 2 * 8 > _HELD_LIMIT:
                        yield out()
                        held = {}
                    held[b] = [0, np.zeros((X.shape[1], X.shape[1])), np.zeros(X.shape[1]), 0.0]
                h = held[b]
                h[0] += len(y)
                h[1] += X.T @ X
                h[2] += X.T @ y
                h[3] += float(y @ y)
        if held:
            yield out()

    return run


def _gram_table(partials: DataFrame, p: int, num_blocks: int = 1) -> DataFrame:
    s = F.col("s")
    return vector_sum(partials, "s", ["block_id"], width=2 + p + p * p, num_groups=num_blocks).select(
        "block_id",
        s[0].cast("long").alias("n"),
        F.slice(s, F.lit(p + 3), F.lit(p * p)).alias("gram"),
        F.slice(s, F.lit(3), F.lit(p)).alias("cross"),
        s[1].alias("yy"),
    )


def chunk_gram(chunks: DataFrame, p: int, num_blocks: int = 1) -> DataFrame:
    """Gram statistics of packed chunks per ``block_id``."""
    source = chunks.select("block_id", "p", "X", "y")
    partials = source.mapInArrow(_gram_partials(_chunk_parts), "block_id long, s array<double>")
    return _gram_table(partials, p, num_blocks)


def gram(data: DataFrame, p: int, num_blocks: int | None = None) -> DataFrame:
    """``<block_id, n, gram, cross, yy>``: A'A row-major, A'b and b'b per block, of chunks or rows.

    Rows stay where they are while the statistics of ``num_blocks`` blocks are smaller
    than a partition of rows; else the rows are shuffled by block first. Rows without a label are
    left out; null or ragged features are an error, at every width.
    """
    if "X" in data.columns:
        return chunk_gram(data, p, num_blocks or 1)
    data = with_label(data)
    if "block_id" not in data.columns:
        data, num_blocks = data.withColumn("block_id", F.lit(0)), 1
    if p <= SMALL_WIDTH:
        return row_gram(data, p)
    if num_blocks is None or num_blocks * p * p * 8 > _IN_PLACE_LIMIT:
        data = spread_blocks(data)
    rows = data.select(
        F.col("block_id").cast("long").alias("block_id"),
        F.col("label").cast("double").alias("label"),
        F.col("features").cast("array<double>").alias("features"),
    )
    partials = rows.mapInArrow(_gram_partials(_row_parts), "block_id long, s array<double>")
    return _gram_table(partials, p, num_blocks or 1)


def cross(data: DataFrame, p: int) -> DataFrame:
    """``<block_id, cross>``: A'b per block."""
    return gram(data, p).select("block_id", "cross")


def exact_sum(value: Column) -> Column:
    """Aggregate: exact sum of whole numbers (bigint) as decimal.

    The high and the low 24 bits are added apart as bigints, several times faster than a
    sum of decimals; the two meet once per group.
    """
    low = value.bitwiseAND(F.lit((1 << 24) - 1))
    high = F.sum(F.shiftright(value, 24)).cast("decimal(28,0)")
    return high * F.lit(1 << 24).cast("decimal(9,0)") + F.sum(low).cast("decimal(28,0)")


def column_gram(
    df: DataFrame, cols: Sequence[Column], by: Sequence[str] = (), whole: bool = False
) -> DataFrame:
    """``<by.., i, j, value>`` for i <= j: sums of products in the type of the columns.

    With ``whole`` the columns and their products are bigints, added without rounding.
    """
    pairs = _triangle(len(cols))
    add = exact_sum if whole else F.sum
    sums = [add(cols[i] * cols[j]).alias(f"_g{i}_{j}") for i, j in pairs]
    wide = df.groupBy(*by).agg(*sums)
    entries = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_g{i}_{j}").alias("value")) for i, j in pairs]
    )
    return wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.i", "e.j", "e.value")


def margins(df: DataFrame, W: np.ndarray) -> DataFrame:
    """Add ``margins = features . W``, one per class; null for vectors that are or hold null."""
    if W.size <= SMALL_WIDTH**2:
        known = whole_vector("features", len(W)).isNotNull()
        return df.withColumn("margins", F.when(known, class_margins("features", W)))

    @F.arrow_udf("array<double>")
    def multiply(features: pa.Array) -> pa.Array:
        X, known = whole_rows(features, len(W))
        M = X @ W
        ends = pa.array(np.arange(len(M) + 1, dtype=np.int32) * W.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array(M.ravel()), mask=pa.array(~known))

    return df.withColumn("margins", multiply(F.col("features").cast("array<double>")))


def softmax(df: DataFrame) -> DataFrame:
    """Add ``softmax`` of the column ``margins``."""
    return df.withColumn("softmax", row_softmax("margins"))


def softmax_sums(df: DataFrame, W: np.ndarray) -> DataFrame:
    """One row ``<n, loss, gradient>``: the multinomial gradient sum (feature-major) and the clipped loss sum.

    Rows carry a class index as ``label``. Few weights are summed in SQL, others by the chunk kernel.
    Null labels and features are treated as by :func:`gram`.
    """
    p, k = W.shape
    if "X" not in df.columns:
        df = with_label(df)
        if W.size > SMALL_WIDTH**2:
            return _softmax_table(_plain_rows(df).mapInArrow(softmax_row_partials(W), "s array<double>"), W)
        rows = softmax(margins(df.select("label", whole_vector("features", p, "raise").alias("features")), W))
        y = F.col("label").cast("int")
        s = F.col("softmax")
        picked = F.element_at(s, y + 1)
        loss = F.sum(-F.log(F.greatest(picked, F.lit(1e-10))))
        flat = [
            F.sum(F.col("features")[i] * (s[c] - F.when(y == c, 1.0).otherwise(0.0))).alias(f"_g{i}_{c}")
            for i in range(p)
            for c in range(k)
        ]
        table = _tree_agg(rows, [], [F.count("*").alias("n"), loss.alias("loss"), *flat])
        gradient = F.array(*[F.col(f"_g{i}_{c}") for i in range(p) for c in range(k)])
        return table.select("n", "loss", gradient.alias("gradient"))

    return _softmax_table(df.select("p", "X", "y").mapInArrow(softmax_partials(W), "s array<double>"), W)


def _plain_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")
    )


def _softmax_table(partials: DataFrame, W: np.ndarray) -> DataFrame:
    s = F.col("s")
    return vector_sum(partials, "s", width=2 + W.size).select(
        s[0].cast("long").alias("n"), s[1].alias("loss"), F.slice(s, F.lit(3), F.lit(W.size)).alias("gradient")
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(X, y)`` of a batch of rows."""
    if batch.num_rows:
        yield feature_matrix(batch), np.asarray(batch.column("label"))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, X, y in chunk_matrices(batch):
        yield X, y


def softmax_partials(W: np.ndarray, parts_of: Callable = _chunks) -> Callable:
    """Kernel: one ``[n, loss, gradient..]`` per partition of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + W.size)
        for batch in batches:
            for X, y in parts_of(batch):
                g, loss = softmax_terms(X, y.astype(np.int64), W)
                total[0] += len(y)
                total[1] += loss
                total[2:] += g.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], _DOUBLES)], names=["s"])

    return run


def softmax_row_partials(W: np.ndarray) -> Callable:
    """The same kernel for unpacked rows."""
    return softmax_partials(W, _matrices)


def softmax_gradient(df: DataFrame, W: np.ndarray, scale: str = "sum", num_blocks: int = 1) -> DataFrame:
    """``<feature_idx, class_idx, value>``: A'(softmax - Y) as sum, mean, or scaled by ``N / n``."""
    factor = {"sum": F.lit(1.0), "mean": 1.0 / F.col("n"), "block": F.lit(float(num_blocks)) / F.col("n")}[scale]
    k = W.shape[1]
    return softmax_sums(df, W).select(factor.alias("f"), F.posexplode("gradient").alias("pos", "g")).select(
        F.floor(F.col("pos") / k).cast("int").alias("feature_idx"),
        (F.col("pos") % k).cast("int").alias("class_idx"),
        (F.col("g") * F.col("f")).alias("value"),
    )


def umlr_penalty(W: np.ndarray, reg: float, eta: float) -> float:
    """``reg/2 |W|^2 + eta/2 sum_{i<j} |w_i|^2 |w_j|^2``."""
    norms = (W**2).sum(axis=0)
    return float(0.5 * reg * norms.sum() + 0.25 * eta * (norms.sum() ** 2 - (norms**2).sum()))


def umlr_loss(df: DataFrame, W: np.ndarray, reg: float = 0.0, eta: float = 0.0) -> DataFrame:
    """``<loss>``: mean cross entropy, log clipped at 1e-10, plus the penalties."""
    penalty = umlr_penalty(W, reg, eta)
    return softmax_sums(df, W).select((F.col("loss") / F.col("n") + F.lit(penalty)).alias("loss"))


def uncorrelated(weights: DataFrame, eta: float = 1.0) -> DataFrame:
    """From a model table: ``<class_idx, feature_idx, weight, coefficient, penalty>``.

    ``coefficient`` is the squared norm of all other classes, ``penalty = eta * weight * coefficient``.
    """
    norms = weights.groupBy("class_idx").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    total = norms.agg(F.sum("norm").alias("total"))
    # one row against K rows
    coefficients = norms.crossJoin(F.broadcast(total)).select(
        "class_idx", (F.col("total") - F.col("norm")).alias("coefficient")
    )
    return weights.join(coefficients, "class_idx").select(
        "class_idx",
        "feature_idx",
        "weight",
        "coefficient",
        (F.lit(eta) * F.col("weight") * F.col("coefficient")).alias("penalty"),
    )


def ls_gradient(df: DataFrame, w: np.ndarray) -> DataFrame:
    """``<feature_idx, value>``: sum of ``x (x.w - y)`` over rows or chunks; nulls as in :func:`gram`."""
    p = len(w)
    if "X" not in df.columns:
        df = with_label(df)
    if p <= SMALL_WIDTH and "X" not in df.columns:
        error = dot("features", w) - F.col("label")
        df = df.select("label", whole_vector("features", p, "raise").alias("features"))
        sums = [F.sum(F.col("features")[i] * F.col("_e")).alias(f"_g{i}") for i in range(p)]
        table = _tree_agg(df.withColumn("_e", error), [], sums)
        total = table.select(F.array(*[F.col(f"_g{i}") for i in range(p)]).alias("g"))
    elif "X" in df.columns:
        total = vector_sum(df.select("p", "X", "y").mapInArrow(ls_partials(w), "g array<double>"), "g", width=p)
    else:
        total = vector_sum(_plain_rows(df).mapInArrow(ls_partials(w, _matrices), "g array<double>"), "g", width=p)
    return total.select(F.posexplode("g").alias("feature_idx", "value"))


def ls_partials(w: np.ndarray, parts_of: Callable = _chunks) -> Callable:
    """Kernel: one gradient sum per partition of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w))
        for batch in batches:
            for X, y in parts_of(batch):
                total += X.T @ (X @ w - y)
        yield pa.RecordBatch.from_arrays([pa.array([total], _DOUBLES)], names=["g"])

    return run


def block_mean(state: DataFrame, *cols: str) -> DataFrame:
    """One row: the mean of every vector column over the blocks."""
    n = F.count("*")
    sums = state.agg(n.alias("_n"), *[collect_sum(c).alias(c) for c in cols])
    return sums.select(*[F.transform(c, lambda v: v / F.col("_n")).alias(c) for c in cols])


def block_median(state: DataFrame, col: str) -> DataFrame:
    """``<pos, value>``: per coordinate the upper median over the blocks, ``sorted[N // 2]``.

    Ranked by a window, so the values of a coordinate are sorted on disk if need be.
    """
    entries = state.select(F.posexplode(col).alias("pos", "value"))
    by_pos = Window.partitionBy("pos")
    ranked = entries.withColumn("_rank", F.row_number().over(by_pos.orderBy("value"))).withColumn(
        "_n", F.count("*").over(by_pos)
    )
    return ranked.filter(F.col("_rank") == F.floor(F.col("_n") / 2) + 1).select("pos", "value")


def _distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda u, v: (u - v) * (u - v))
    return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v)


def consensus_residuals(state: DataFrame, previous: DataFrame, rho: float, key: str = "block_id") -> DataFrame:
    """``<primal, dual>``: sum of |x_i - mean x| and N rho^2 |mean x - mean x_previous|."""
    now = block_mean(state, "x").withColumnRenamed("x", "x_bar")
    before = block_mean(previous, "x").withColumnRenamed("x", "x_before")
    # one row each
    spread = state.select("x").crossJoin(F.broadcast(now.crossJoin(before)))
    return spread.agg(
        F.sum(F.sqrt(_distance(F.col("x"), F.col("x_bar")))).alias("primal"),
        (F.count("*") * F.lit(rho**2) * F.first(F.sqrt(_distance(F.col("x_bar"), F.col("x_before"))))).alias("dual"),
    )


def sharing_residuals(
    rows: DataFrame, state: DataFrame, previous: DataFrame, num_blocks: int, key: str = "block_id"
) -> DataFrame:
    """``<primal, dual>``: N |abar - z| over all rows and sum of |x_i - x_i,previous|.

    ``rows`` holds the vectors ``abar`` and ``z`` of a row or a chunk of rows.
    """
    primal = rows.agg((F.lit(num_blocks) * F.sqrt(F.sum(_distance(F.col("abar"), F.col("z"))))).alias("primal"))
    old = previous.select(key, F.col("x").alias("x_before"))
    dual = state.join(old, key).agg(F.sum(F.sqrt(_distance(F.col("x"), F.col("x_before")))).alias("dual"))
    return primal.crossJoin(dual)


def mean_abs_change(a: DataFrame, b: DataFrame, keys: Sequence[str], col: str = "weight") -> DataFrame:
    """``<diff>``: mean absolute difference of two coefficient tables."""
    other = b.select(*keys, F.col(col).alias("_other"))
    return a.join(other, list(keys)).agg(F.avg(F.abs(F.col(col) - F.col("_other"))).alias("diff"))


def _solve(s: float, r: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rhs = [np.asarray(v.values) for v in batch.column("rhs")]
            out = []
            for g, b in zip(batch.column("gram"), rhs):
                p = int(round(len(g.values) ** 0.5))
                M = scaled_inverse(np.asarray(g.values).reshape(p, p), s, r)
                out.append((M @ b.reshape(p, -1)).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block_id"), pa.array(out, _DOUBLES)], names=["block_id", "solution"]
            )

    return run


def solve_blocks(blocks: DataFrame, s: float = 1.0, r: float = 0.0, rhs: str = "cross") -> DataFrame:
    """``<block_id, solution>``: ``(s G + r I)^-1 rhs`` of every row of a block table."""
    table = blocks.select(F.col("block_id").cast("long").alias("block_id"), "gram", F.col(rhs).alias("rhs"))
    return table.mapInArrow(_solve(s, r), "block_id long, solution array<double>")
