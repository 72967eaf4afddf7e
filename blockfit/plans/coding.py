"""Weighted-Huber sparse coding of test rows on class dictionaries.

A test row b is coded on the dictionary A of a class (pixels x training rows): two outer
passes set pixel weights from the residuals, each followed by rounds of ADMM with a Huber
fit term and a sparse code.

A dictionary that fits a task is joined whole to chunks of test rows. A larger one is never
gathered: the code of its rows follows from a few vectors of pixel length per test row, so
each ADMM round sums ``A d`` over tiles (test chunk x dictionary chunk) and goes on from
``A A'``, ``A 1`` and the size of the class alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockfit.functions.arrays import collect_sum
from blockfit.operators.blocks import MAX_CHUNK_BYTES, pack_chunks
from blockfit.operators.linalg import chunk_gram, vector_sum
from blockfit.operators.prepare import label_index
from blockfit.plans.kernels import soft
from blockfit.session import cut_lineage, drop_checkpoint

_DOUBLES = pa.list_(pa.float64())
# of tests or of dictionary rows in a cell
MAX_CELL_BYTES = 32 << 20
_KEEP = StorageLevel.MEMORY_AND_DISK


@dataclass(frozen=True)
class CodingParams:
    t: float = 0.7
    c: float = 1.0
    outer: int = 2
    inner: int = 2
    rho1: float = 1.0
    rho2: float = 1.0
    lam: float = 1.0
    eta_scale: float = 10.0
    ridge: str = "identity"


def class_mean(df: DataFrame) -> DataFrame:
    """``<label, features>``: the mean training vector of every class."""
    total = collect_sum(F.col("features").cast("array<double>"))
    sums = df.groupBy("label").agg(F.count("*").alias("_n"), total.alias("features"))
    return sums.select("label", F.transform("features", lambda v: v / F.col("_n")).alias("features"))


def collect_vectors(df: DataFrame, key: str, rows_per_part: int = 4096, by: str = "hash") -> DataFrame:
    """``<key, part, row_ids, vectors>``: the vectors of a group in row order.

    A group comes in parts by a hash of the row, about ``rows_per_part`` rows each, so
    that no task holds a whole group; a group of at most that size is one part. ``by="range"`` takes
    the rows of so many consecutive ids to a part.
    """
    if by == "range":
        placed = df.withColumn("part", F.floor(F.col("row_id") / F.lit(rows_per_part)).cast("int"))
    else:
        sizes = df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(rows_per_part)).alias("_parts"))
        placed = df.join(sizes, key).withColumn(
            "part", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")
        )
    rows = F.array_sort(F.collect_list(F.struct("row_id", "features")))
    grouped = placed.groupBy(key, "part").agg(rows.alias("rows"))
    return grouped.select(
        key, "part", F.col("rows.row_id").alias("row_ids"), F.col("rows.features").alias("vectors")
    )


# --- the coding steps on arrays (tests x pixels) ---------------------------------------------


def pixel_weights(squared: np.ndarray, t: float, c: float) -> np.ndarray:
    """Logistic weights per test row around the order statistic of its squared residuals."""
    at = np.sort(squared, axis=1)[:, int(squared.shape[1] * t)][:, None]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        w = 1.0 / (1.0 + np.exp(c / at * (squared - at)))
    return np.where(at == 0, (squared <= at).astype(float), w)


class _Outer:
    """State of one outer pass: pixel vectors per test row, everything but the code itself."""

    def __init__(self, B: np.ndarray, root: np.ndarray, params: CodingParams):
        self.root, self.params = root, params
        self.b = root * B
        self.z = np.ones_like(B)
        self.uz = np.ones_like(B)

    def right(self) -> np.ndarray:
        """``g`` with right-hand side ``rho1 (W A)' g + rho2 (code part)``."""
        return self.z - self.uz + self.b

    def absorb(self, Ax: np.ndarray) -> None:
        """Huber prox and dual step, given ``A x`` (unweighted)."""
        P = self.params
        fit = self.root * Ax - self.b
        v = fit + self.uz
        share = v / (1 + P.rho1)
        self.z = P.rho1 * share + soft(share, P.eta_scale * self.root / P.rho1)
        self.uz = self.uz + fit - self.z


class _PixelSpaceSolver:
    """The ridge step of all tests of a chunk in pixel space, from ``G = A A'``, ``m = A 1`` and n.

    ``x_i = a_i . f + gamma d_i + shift`` for dictionary row i, ``d`` being the code part
    of the right-hand side.
    """

    def __init__(self, G: np.ndarray, m: np.ndarray, n: float, root: np.ndarray, params: CodingParams):
        self.G, self.m, self.n, self.root, self.params = G, m, n, root, params
        WG = root[:, :, None] * G[None] * root[:, None, :]
        if params.ridge == "identity":
            self.gamma = 1.0
            self.S = WG + params.rho2 / params.rho1 * np.eye(G.shape[0])
        else:
            self.gamma = 0.0
            p = G.shape[0]
            S = np.empty((len(root), p + 1, p + 1))
            edge = np.sqrt(params.rho1 * params.rho2) * root * m
            S[:, :p, :p] = params.rho1 * WG
            S[:, :p, p] = S[:, p, :p] = edge
            S[:, p, p] = params.rho2 * n
            self.S = np.linalg.pinv(S, rcond=1e-15 * (p + 1), hermitian=True)

    def solve(self, g: np.ndarray, Ad: np.ndarray, sum_d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(f, shift, A x)`` for right-hand side ``rho1 (W A)' g + rho2 d``."""
        P, root = self.params, self.root
        if P.ridge == "identity":
            # not as a difference from g, which leaves no digits of a small f where G is large
            f = root * np.linalg.solve(self.S, (g - root * Ad)[:, :, None])[:, :, 0]
            shift = np.zeros(len(g))
        else:
            wg = root * g
            Aq = P.rho1 * wg @ self.G + P.rho2 * Ad
            sum_q = P.rho1 * wg @ self.m + P.rho2 * sum_d
            Bq = np.column_stack([np.sqrt(P.rho1) * root * Aq, np.sqrt(P.rho2) * sum_q])[:, :, None]
            s = (self.S @ (self.S @ Bq))[:, :, 0]
            f = np.sqrt(P.rho1) * root * s[:, :-1]
            shift = np.sqrt(P.rho2) * s[:, -1]
        Ax = f @ self.G + self.gamma * Ad + shift[:, None] * self.m
        return f, shift, Ax


def code_parts(rows: np.ndarray, steps: list, gamma: float, threshold: float) -> np.ndarray:
    """``d = W - Uw`` (tests x rows) of dictionary rows after the solved ``steps`` ``(f, shift)``.

    ``W`` is ``x + Uw`` shrunk by the threshold and the new ``Uw`` what the shrinking takes off, ``x + Uw`` clipped.
    """
    d = uw = None
    for f, shift in steps:
        x = f @ rows.T
        if uw is None:
            x += (shift + 1)[:, None]
        else:
            x += shift[:, None]
            x += uw
            if gamma:
                x += gamma * d
        uw = np.clip(x, -threshold, threshold)
        d = x
        d -= uw
        d -= uw
    return d


class RowBox:
    """Dictionary rows between two corners, with their sums, halved down to ``leaf`` rows.

    A box is cut along the side that is widest in units of the whole dictionary, ``span``. It puts ``rows`` in its own
    order; equal rows stay in one box.
    """

    def __init__(self, rows: np.ndarray, leaf: int, span: np.ndarray | None = None):
        low, high = rows.min(axis=0), rows.max(axis=0)
        self.rows, self.centre, self.reach = rows, (low + high) / 2, (high - low) / 2
        span = np.where(high > low, high - low, 1.0) if span is None else span
        side = int(np.argmax((high - low) / span))
        if len(rows) > leaf and high[side] > low[side]:
            half = len(rows) // 2
            rows[:] = rows[np.argpartition(rows[:, side], half)]
            self.halves = (RowBox(rows[:half], leaf, span), RowBox(rows[half:], leaf, span))
            self.sum = self.halves[0].sum + self.halves[1].sum
            self.gram = self.halves[0].gram + self.halves[1].gram
        else:
            self.halves, self.sum, self.gram = (), rows.sum(axis=0), rows.T @ rows

    def lines(self, steps: list, gamma: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``d = slope . row + const`` of the tests for which no threshold cuts the box, and which these are."""
        whole = np.ones(len(steps[0][0]), dtype=bool)
        d_slope, d_const, u_slope, u_const = 0.0, 0.0, 0.0, 1.0
        for f, shift in steps:
            slope, const = f + gamma * d_slope + u_slope, shift + gamma * d_const + u_const
            middle, reach = slope @ self.centre + const, np.abs(slope) @ self.reach
            low, high = middle - reach, middle + reach
            above, inside = low >= threshold, (low >= -threshold) & (high <= threshold)
            whole &= above | inside | (high <= -threshold)
            if not whole.any():
                return slope, const, whole
            u_slope = slope * inside[:, None]
            u_const = np.where(inside, const, np.where(above, threshold, -threshold))
            d_slope, d_const = slope - 2 * u_slope, const - 2 * u_const
        return d_slope, d_const, whole


# entries of a block tests x dictionary rows
_BLOCK = 1 << 16


def row_box(A: np.ndarray) -> RowBox:
    """The boxes of a dictionary, of more rows than their sums take."""
    return RowBox(A.copy(), max(64, 4 * A.shape[1]))


def code_sums(root: RowBox, steps: list, gamma: float, threshold: float) -> np.ndarray:
    """``[A d, sum d]`` per test row, ``d`` being the code part of :func:`code_parts`.

    A box that no threshold cuts gives its share from its sums; of the others the halves are looked at, and the
    single rows at the end, in blocks, so that no matrix of all tests and rows is ever held.
    """
    tests, p = steps[0][0].shape
    out = np.zeros((tests, p + 1))
    todo = [(root, np.arange(tests), steps)]
    while todo:
        box, at, here = todo.pop()
        if len(at) * len(box.rows) > _BLOCK >> 4:
            slope, const, whole = box.lines(here, gamma, threshold)
            if whole.any():
                done, slope, const = at[whole], slope[whole], const[whole]
                out[done, :p] += slope @ box.gram + const[:, None] * box.sum
                out[done, p] += slope @ box.sum + const * len(box.rows)
                at, here = at[~whole], [(f[~whole], shift[~whole]) for f, shift in here]
            if box.halves and len(at):
                todo += [(half, at, here) for half in box.halves]
                continue
        size = max(1, _BLOCK // len(box.rows))
        for lo in range(0, len(at), size):
            some = slice(lo, lo + size)
            d = code_parts(box.rows, [(f[some], shift[some]) for f, shift in here], gamma, threshold)
            out[at[some], :p] += d @ box.rows
            out[at[some], p] += d.sum(axis=1)
    return out


def _code_by_rows(B, A, root, params) -> np.ndarray:
    """``A x`` after the inner rounds with the matrices of dictionary size (few training rows)."""
    P = params
    outer = _Outer(B, root, P)
    n = A.shape[0]
    M = P.rho1 * np.einsum("ip,tp,jp->tij", A, root**2, A, optimize=True)
    if P.ridge == "identity":
        solve = np.linalg.inv(M + P.rho2 * np.eye(n))
    else:
        solve = np.linalg.pinv(M + P.rho2, rcond=1e-15, hermitian=True)
    w, uw = np.ones((len(B), n)), np.ones((len(B), n))
    Ax = np.zeros_like(B)
    for _ in range(P.inner):
        right = P.rho1 * (root * outer.right()) @ A.T + P.rho2 * (w - uw)
        x = np.einsum("tij,tj->ti", solve, right)
        Ax = x @ A
        outer.absorb(Ax)
        w = soft(x + uw, P.lam / P.rho2)
        uw = uw + x - w
    return Ax


def _code_by_pixels(B, box: RowBox, root, params) -> np.ndarray:
    """``A x`` after the inner rounds with the matrices of pixel size (many training rows)."""
    outer = _Outer(B, root, params)
    solver = _PixelSpaceSolver(box.gram, box.sum, len(box.rows), root, params)
    steps, Ad, sum_d, Ax = [], np.zeros_like(B), np.zeros(len(B)), np.zeros_like(B)
    for i in range(params.inner):
        if i > 0:
            sums = code_sums(box, steps, solver.gamma, params.lam / params.rho2)
            Ad, sum_d = sums[:, :-1], sums[:, -1]
        f, shift, Ax = solver.solve(outer.right(), Ad, sum_d)
        outer.absorb(Ax)
        steps.append((f, shift))
    return Ax


def code_tests(B: np.ndarray, A: np.ndarray, params: CodingParams) -> np.ndarray:
    """Weighted absolute residuals (tests x pixels) of the rows ``B`` on a whole dictionary ``A``."""
    out = np.empty_like(B)
    side = min(len(A), A.shape[1] + 1)
    step = max(1, (16 << 20) // (side * side * 8))
    by_rows = len(A) <= A.shape[1]
    box = None if by_rows else row_box(A)
    mean = A.mean(axis=0)
    for lo in range(0, len(B), step):
        b = B[lo : lo + step]
        fitted = np.broadcast_to(mean, b.shape)
        for _ in range(params.outer):
            root = np.sqrt(pixel_weights((b - fitted) ** 2, params.t, params.c))
            fitted = _code_by_rows(b, A, root, params) if by_rows else _code_by_pixels(b, box, root, params)
        out[lo : lo + step] = root * np.abs(b - fitted)
    return out


# --- jobs ------------------------------------------------------------------------------------


def _result_batch(ids, class_idx: int, residual: np.ndarray) -> pa.RecordBatch:
    n, p = residual.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * p)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(np.full(n, class_idx, dtype=np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(residual.ravel())),
            pa.array(residual[:, :-1].sum(axis=1) / p),
        ],
        names=["test_id", "class_idx", "residual", "mae"],
    )


def _whole_kernel(params: CodingParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, p = batch.column("class_idx"), batch.column("p")
            for i in range(batch.num_rows):
                width = p[i].as_py()
                A = np.frombuffer(batch.column("A")[i].as_buffer()).reshape(-1, width)
                B = np.frombuffer(batch.column("X")[i].as_buffer()).reshape(-1, width)
                ids = batch.column("row_ids")[i].values
                yield _result_batch(ids, classes[i].as_py(), code_tests(B, A, params))

    return run


_RESULT = "test_id long, class_idx int, residual array<double>, mae double"


def _pairs(tests: DataFrame, class_idx: list[int]) -> DataFrame:
    """Every test chunk once per class; these pairs are what the result consists of."""
    each = F.explode(F.array(*[F.lit(k) for k in class_idx]))
    return tests.select("chunk_id", "p", "X", "row_ids", each.alias("class_idx"))


def _join_by_class(pairs: DataFrame, table: DataFrame, classes: int, size: int, limit: int) -> DataFrame:
    """Join a table of one row per class: broadcast while small, else copied per salt.

    All classes have the same number of pairs, so the salt only makes enough tasks.
    """
    if size <= limit:
        return pairs.join(F.broadcast(table), "class_idx")
    salts = max(1, -(-2 * pairs.sparkSession.sparkContext.defaultParallelism // classes))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    return salted.join(copies, ["class_idx", "salt"]).drop("salt")


def _code_whole(tests: DataFrame, dictionary: DataFrame, class_idx: list[int], total_bytes: int, params, limit, tasks):
    """Classes whose dictionary fits one task: equal pairs (test chunk, class), dealt to ``tasks`` or spread by a salt."""
    packed = pack_chunks(dictionary, max_chunk_bytes=1 << 40, whole_blocks=True).select(
        F.col("block_id").cast("int").alias("class_idx"), F.col("X").alias("A")
    )
    pairs = _pairs(tests, class_idx).repartition(tasks)
    joined = _join_by_class(pairs, packed, len(class_idx), total_bytes, limit)
    return joined.select("class_idx", "p", "X", "row_ids", "A").mapInArrow(_whole_kernel(params), _RESULT)


_PAIR_SCHEMA = (
    "chunk_id long, class_idx int, p int, X binary, row_ids array<long>, root binary, z binary, uz binary, "
    "steps binary, fitted binary"
)


def _advance_pairs(params: CodingParams, first: bool, new_outer: bool, last: bool):
    """Kernel over (test chunk, class) pairs: the next ridge step in pixel space.

    ``steps`` holds the solved ``(f, shift)`` of the outer pass so far, tests x (p + 1) each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                p = row["p"].as_py()

                def read(name, width=p, row=row):
                    return np.frombuffer(row[name].as_buffer()).reshape(-1, width)

                B = read("X")
                m, n = np.asarray(row["m"].values), row["n"].as_py()
                G = np.asarray(row["G"].values).reshape(p, p)
                fitted = np.broadcast_to(m / n, B.shape) if first else read("fitted")
                if new_outer:
                    root = np.sqrt(pixel_weights((B - fitted) ** 2, params.t, params.c))
                    outer, steps = _Outer(B, root, params), np.zeros((0, p + 1))
                    Ad, sum_d = np.zeros_like(B), np.zeros(len(B))
                else:
                    root = read("root")
                    outer, steps = _Outer(B, root, params), read("steps", p + 1)
                    outer.z, outer.uz = read("z"), read("uz")
                    sums = np.asarray(row["sums"].values).reshape(-1, p + 1)
                    Ad, sum_d = sums[:, :-1], sums[:, -1]
                solver = _PixelSpaceSolver(G, m, n, root, params)
                f, shift, fitted = solver.solve(outer.right(), Ad, sum_d)
                outer.absorb(fitted)
                if last:
                    yield _result_batch(row["row_ids"].values, row["class_idx"].as_py(), root * np.abs(B - fitted))
                    continue
                steps = np.concatenate([steps, np.column_stack([f, shift])])
                blobs = [B, root, outer.z, outer.uz, steps, fitted]
                binary = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in blobs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk_id"].as_py()], pa.int64()),
                        pa.array([row["class_idx"].as_py()], pa.int32()),
                        pa.array([p], pa.int32()),
                        binary[0],
                        pa.array([row["row_ids"].values], pa.list_(pa.int64())),
                        *binary[1:],
                    ],
                    names=[c.split()[0] for c in _PAIR_SCHEMA.split(", ")],
                )

    return run


def _cell_sums(gamma: float, threshold: float):
    """Kernel over a cell of the grid: ``[A d, sum d]`` per test row over the dictionary rows of the cell."""

    def run(tests: pa.Table, parts: pa.Table) -> pa.Table:
        ids, classes, out = [], [], []
        if tests.num_rows and parts.num_rows:
            p = tests.column("p")[0].as_py()
            box = row_box(np.concatenate([np.frombuffer(a.as_buffer()).reshape(-1, p) for a in parts.column("A")]))
            lengths = pc.list_value_length(tests.column("row_ids")).to_numpy()
            flats = [np.frombuffer(s.as_buffer()).reshape(-1, p + 1) for s in tests.column("steps")]
            split = [np.split(flat, len(flat) // n) for flat, n in zip(flats, lengths)]
            done = [np.concatenate(step) for step in zip(*split)]
            sums = code_sums(box, [(s[:, :-1], s[:, -1]) for s in done], gamma, threshold)
            ids, classes = tests.column("chunk_id").to_pylist(), tests.column("class_idx").to_pylist()
            out = [part.ravel() for part in np.split(sums, np.cumsum(lengths)[:-1])]
        columns = [pa.array(ids, pa.int64()), pa.array(classes, pa.int32()), pa.array(out, _DOUBLES)]
        return pa.Table.from_arrays(columns, names=["chunk_id", "class_idx", "sums"])

    return run


def _grid_shape(sizes: dict[int, int], steps_bytes: int, cell_bytes: int) -> tuple[dict[int, int], int]:
    """The columns of every class and the rows of the grid, for cells of ``cell_bytes`` of either side."""
    return {k: -(-size // cell_bytes) for k, size in sizes.items()}, max(1, -(-steps_bytes // cell_bytes))


def _cell_size(sizes: dict[int, int], steps_bytes: int, cell_bytes: int, most: int) -> int:
    """``cell_bytes``, or as much more as leaves at most ``most`` cells, yet no more than fits a task.

    Cells of a fixed size grow in number with the square of the data, and so does what is copied to them.
    """
    while cell_bytes < MAX_CELL_BYTES:
        columns, rows = _grid_shape(sizes, steps_bytes, cell_bytes)
        if sum(columns.values()) * rows <= most:
            break
        cell_bytes = min(2 * cell_bytes, MAX_CELL_BYTES)
    return cell_bytes


def _grid(pairs: DataFrame, parts: DataFrame, columns: dict[int, int], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to the cells ``(class_idx, column, row)`` of a grid.

    A class has as many ``columns`` as its dictionary fills cells; the tests of every class have ``rows`` rows. A
    test chunk is copied once for each column of a class, a dictionary chunk once for each row.
    """
    width = F.element_at(F.create_map(*[F.lit(x) for k in sorted(columns.items()) for x in k]), F.col("class_idx"))
    to_all = F.explode(F.sequence(F.lit(0), width - 1))
    tests = pairs.withColumn("column", to_all).withColumn(
        "row", F.pmod(F.xxhash64("chunk_id", "class_idx"), F.lit(rows)).cast("int")
    )
    place = F.pmod(F.xxhash64("dict_id"), width).cast("int")
    dictionary = parts.withColumn("column", place).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return tests, dictionary


def _code_tiled(
    tests: DataFrame,
    dictionary: DataFrame,
    sizes: dict[int, int],
    test_bytes: int,
    p: int,
    params: CodingParams,
    limit: int,
    cell_bytes: int,
) -> DataFrame:
    """Classes too large for one task: test chunks and dictionary chunks meet in the cells of a grid.

    What moves in a step is the tests times the columns and the dictionary times the rows, not the dictionary times
    the test chunks; a large class fills many cells.
    """
    class_idx = sorted(sizes)
    steps_bytes = test_bytes * params.inner * (p + 1) // p
    cell_bytes = _cell_size(sizes, steps_bytes, cell_bytes, 8 * tests.sparkSession.sparkContext.defaultParallelism)
    columns, rows = _grid_shape(sizes, steps_bytes, cell_bytes)
    ones = dictionary.withColumn("label", F.lit(1.0))
    chunks = pack_chunks(ones, sort=False, max_chunk_bytes=max(1, min(MAX_CHUNK_BYTES, cell_bytes // 8))).persist(_KEEP)
    stats = (
        chunk_gram(chunks, p)
        .select(
            F.col("block_id").cast("int").alias("class_idx"),
            F.col("n").cast("double").alias("n"),
            F.col("gram").alias("G"),
            F.col("cross").alias("m"),
        )
        .persist(_KEEP)
    )
    parts = chunks.select(
        F.col("block_id").cast("int").alias("class_idx"), F.col("chunk_id").alias("dict_id"), F.col("X").alias("A")
    )
    threshold = params.lam / params.rho2
    gamma = 1.0 if params.ridge == "identity" else 0.0
    pairs = _pairs(tests, class_idx)
    stats_bytes = len(class_idx) * (p * p + p) * 8
    saved: DataFrame | None = None
    for o in range(params.outer):
        for i in range(params.inner):
            first, last = o == i == 0, (o, i) == (params.outer - 1, params.inner - 1)
            source = _join_by_class(pairs, stats, len(class_idx), stats_bytes, limit)
            if i > 0:
                sides = _grid(pairs.select("chunk_id", "class_idx", "p", "row_ids", "steps"), parts, columns, rows)
                cells = (side.groupBy("class_idx", "column", "row") for side in sides)
                partial = next(cells).cogroup(next(cells)).applyInArrow(
                    _cell_sums(gamma, threshold), "chunk_id long, class_idx int, sums array<double>"
                )
                sums = vector_sum(partial, "sums", ["chunk_id", "class_idx"], num_partials=max(columns.values()))
                source = source.join(sums, ["chunk_id", "class_idx"])
            kernel = _advance_pairs(params, first, i == 0, last)
            if last:
                return source.mapInArrow(kernel, _RESULT)
            pairs = cut_lineage(source.mapInArrow(kernel, _PAIR_SCHEMA))
            if saved is not None:
                drop_checkpoint(saved)
            saved = pairs
    raise ValueError("outer and inner must be at least 1")


def huber_sparse_code(
    test: DataFrame,
    train: DataFrame,
    t: float = 0.7,
    c: float = 1.0,
    outer: int = 2,
    inner: int = 2,
    rho1: float = 1.0,
    rho2: float = 1.0,
    lam: float = 1.0,
    eta_scale: float = 10.0,
    ridge: str = "identity",
    test_chunk_bytes: int = 1 << 20,
    max_dictionary_bytes: int = 64 << 20,
    broadcast_limit: int = 64 << 20,
    cell_bytes: int = MAX_CELL_BYTES,
) -> DataFrame:
    """Code every test row on every class: ``<test_id, class_idx, class_label, residual, mae>``.

    ``test`` is ``<row_id, features>``, ``train`` ``<row_id, label, features>``. ``ridge`` is
    the term added to the normal equations: ``"identity"`` on the diagonal (the ADMM step)
    or ``"scalar"`` on every entry. Dictionaries above ``max_dictionary_bytes`` are coded in
    a grid of cells with ``cell_bytes`` of tests and of dictionary rows each, or up to ``MAX_CELL_BYTES`` where there
    would be too many; smaller ones are broadcast while all together stay below ``broadcast_limit``.
    """
    if ridge not in ("identity", "scalar"):
        raise ValueError(f"unknown ridge {ridge!r}")
    params = CodingParams(t, c, outer, inner, rho1, rho2, lam, eta_scale, ridge)
    sizes = (
        train.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p"))
        .orderBy("label")
        .collect()
    )
    classes, p = [r["label"] for r in sizes], sizes[0]["p"]
    rows = label_index(train, classes).withColumn("block_id", F.col("label").cast("int"))
    size_of = {k: r["n"] * r["p"] * 8 for k, r in enumerate(sizes)}
    small = sorted(k for k, size in size_of.items() if size <= max_dictionary_bytes)
    large = sorted(k for k, size in size_of.items() if size > max_dictionary_bytes)
    unlabeled = test.select("row_id", F.lit(0.0).alias("label"), "features")
    # chunks small enough that the pairs occupy all cores, yet of some thousand tests where there are as many
    test_bytes = test.count() * p * 8
    wanted = 4 * test.sparkSession.sparkContext.defaultParallelism
    chunk_bytes = min(test_chunk_bytes, max(1024 * p * 8, -(-test_bytes * len(classes) // wanted)))
    tests = pack_chunks(unlabeled, max_chunk_bytes=chunk_bytes)
    results = []
    if small:
        part = rows.filter(F.col("block_id").isin(small)) if large else rows
        total = sum(size_of[k] for k in small)
        tasks = max(1, min(wanted, -(-test_bytes // chunk_bytes) * len(small)))
        results.append(_code_whole(tests, part, small, total, params, broadcast_limit, tasks))
    if large:
        part = rows.filter(F.col("block_id").isin(large)) if small else rows
        sizes = {k: size_of[k] for k in large}
        results.append(_code_tiled(tests, part, sizes, test_bytes, p, params, broadcast_limit, cell_bytes))
    codes = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    labels = F.array(*[F.lit(k) for k in classes])
    return codes.select(
        "test_id",
        "class_idx",
        labels[F.col("class_idx")].alias("class_label"),
        "residual",
        "mae",
    )


def classify_by_residual(codes: DataFrame) -> DataFrame:
    """``<test_id, prediction, mae>``: the class of the smallest residual, the first one among equals."""
    best = F.min(F.struct("mae", "class_idx", "class_label"))
    return codes.groupBy("test_id").agg(best.alias("best")).select(
        "test_id", F.col("best.class_label").alias("prediction"), F.col("best.mae").alias("mae")
    )
