"""Sharing trainers: every feature block has its own weights, tied by the row sums ``z``.

The columns are never split physically. With ``x`` known, ``Abar = X x / N`` belongs to a
row, and ``A_j'(A_j x_j + z - Abar - u) = G_jj x_j + [X'(z - Abar - u)]_j``. So a round is
one pass over the row chunks: it brings ``z`` and ``u`` of the chunk forward and adds up the
p x K matrix ``X'(z - Abar - u)``, from which the feature blocks are solved. ``z`` and ``u``
(n x K) live in a table keyed by chunk. Python operators forget their partitioning, so a
round exchanges this table; the cached chunks stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockfit.model import Model
from blockfit.operators.blocks import MAX_CHUNK_BYTES, chunk_matrices, feature_blocks, pack_chunks
from blockfit.operators.linalg import driver_sum, gram, vector_sum, with_label
from blockfit.plans.kernels import (
    AdamMoments,
    lasso_block,
    scaled_inverse,
    soft,
    softmax_columns,
    softmax_residual,
    uncorrelated_coefficients,
)
from blockfit.plans.rounds import STATS_LIMIT, indexed, num_features, run_admm
from blockfit.session import cut_lineage, drop_checkpoint, fixed_plans, partition_count

_DOUBLES = pa.list_(pa.float64())
_KEEP = StorageLevel.MEMORY_AND_DISK

# (G_j, R_j, x_j) -> new x_j
BlockSolver = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
# (z, abar, u, y) -> new z
RowStep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


# --- block solvers and row steps ---------------------------------------------------------


def lasso_solver(lam: float, rho: float, x_step: str) -> Callable[[np.ndarray], Callable]:
    """``argmin lam |x|_1 + rho/2 |A_j x - v_j|^2``, exact or by the two-sided closed form."""

    def prepare(G: np.ndarray):
        inverse = scaled_inverse(G, 1.0, 0.0) if x_step == "closed_form" else None

        def solve(R: np.ndarray, x: np.ndarray) -> np.ndarray:
            a, k = G @ x + R, lam / rho
            if inverse is None:
                return np.column_stack([lasso_block(G, a[:, c], x[:, c], k) for c in range(a.shape[1])])
            lo, hi = inverse @ (a - k), inverse @ (a + k)
            return np.where(lo > 0, lo, np.where(hi < 0, hi, 0.0))

        return solve

    return prepare


def sparse_solver(lam: float, rho: float, inner_iter: int, inner_tol: float | None) -> Callable:
    """Inner ADMM on ``lam |x|_1 + rho/2 |A_j x - t_j|^2`` with penalty 1, from zero each time."""

    def prepare(G: np.ndarray):
        inverse = scaled_inverse(G, rho, 1.0)

        def solve(R: np.ndarray, x: np.ndarray) -> np.ndarray:
            fixed = rho * (G @ x + R)
            z = u = np.zeros_like(x)
            for _ in range(inner_iter):
                v = inverse @ (fixed + z - u)
                z, before = soft(v + u, lam), z
                u = u + v - z
                if inner_tol is not None and np.linalg.norm(z - before) < inner_tol:
                    break
            return z

        return solve

    return prepare


def ridge_solver(eta: float, rho: float) -> Callable:
    """``rho pinv(eta c_k I + rho G_j)(G_j x_k + R_k)`` per class, ``c`` from the weights of the block.

    One eigendecomposition per fit makes every later solve diagonal.
    """

    def prepare(G: np.ndarray):
        values, vectors = np.linalg.eigh(G)

        def solve(R: np.ndarray, x: np.ndarray) -> np.ndarray:
            right = vectors.T @ (G @ x + R)
            d = eta * uncorrelated_coefficients(x)[None, :] + rho * values[:, None]
            cut = 1e-15 * len(values) * np.abs(d).max(axis=0, keepdims=True)
            small = np.abs(d) <= cut
            return vectors @ np.where(small, 0.0, rho * right / np.where(small, 1.0, d))

        return solve

    return prepare


def squared_rows(n_blocks: int, rho: float) -> RowStep:
    def step(z, abar, u, y):
        return (y[:, None] + rho * (abar + u)) / (n_blocks + rho)

    return step


def softmax_adam_rows(n_blocks: int, rho: float, alpha: float, z_steps: int) -> RowStep:
    def step(z, abar, u, y):
        # classes x rows, the layout the softmax wants
        at = (y.astype(np.int64), np.arange(len(y)))
        z, pull = np.array(z.T, order="C"), rho * (abar + u).T
        adam = AdamMoments(z.shape, alpha)
        for _ in range(z_steps):
            g = softmax_columns(n_blocks * z)
            g[at] -= 1.0
            g += rho * z
            g -= pull
            g *= n_blocks
            z -= adam.step(g)
        return np.ascontiguousarray(z.T)

    return step


def softmax_gradient_rows(n_blocks: int, rho: float, epsilon: float) -> RowStep:
    def step(z, abar, u, y):
        g = softmax_residual(n_blocks * z, y.astype(np.int64)) + rho * (z - abar - u)
        return z - epsilon * n_blocks * g

    return step


# --- the blocks ----------------------------------------------------------------------------


def _gram_blocks(blocks: Sequence[tuple[int, int]]):
    """Kernel: per partition the diagonal Gram blocks and the column sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((hi - lo, hi - lo)) for lo, hi in blocks]
        sums = np.zeros(blocks[-1][1])
        for batch in batches:
            for _, X, _y in chunk_matrices(batch):
                for g, (lo, hi) in zip(total, blocks):
                    g += X[:, lo:hi].T @ X[:, lo:hi]
                sums += X.sum(axis=0)
        for j, (g, (lo, hi)) in enumerate(zip(total, blocks)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([j], pa.int32()), pa.array([np.concatenate([sums[lo:hi], g.ravel()])], _DOUBLES)],
                names=["block_id", "s"],
            )

    return run


class _BlockStep:
    """Solves all feature blocks: on the driver while their Gram matrices fit, else as tasks."""

    def __init__(self, chunks: DataFrame, parts: int, blocks, prepare: Callable, stats_limit: int):
        self.blocks, self.prepare = blocks, prepare
        partials = chunks.select("p", "X", "y").mapInArrow(_gram_blocks(blocks), "block_id int, s array<double>")
        widest = max(hi - lo for lo, hi in blocks)
        table = vector_sum(
            partials, "s", ["block_id"], width=widest + widest**2, num_partials=parts, num_groups=len(blocks)
        )
        self.held = sum((hi - lo) ** 2 for lo, hi in blocks) * 8 <= stats_limit
        self.sums = np.zeros(blocks[-1][1])
        if self.held:
            self.solvers: dict[int, Callable] = {}
            for j, s in self._rows(table):
                width = blocks[j][1] - blocks[j][0]
                self._note_sums(j, s[:width])
                self.solvers[j] = prepare(s[width:].reshape(width, width))
        else:
            self.table = table.repartition(len(blocks), "block_id").persist(_KEEP)
            widths = F.array(*[F.lit(hi - lo) for lo, hi in blocks])[F.col("block_id")]
            for j, s in self._rows(self.table.select("block_id", F.slice("s", F.lit(1), widths).alias("s"))):
                self._note_sums(j, s)

    @staticmethod
    def _rows(table: DataFrame):
        for row in table.toArrow().to_batches():
            for j, s in zip(row.column("block_id").to_pylist(), row.column("s")):
                yield j, np.asarray(s.values)

    def _note_sums(self, j: int, s: np.ndarray) -> None:
        lo, hi = self.blocks[j]
        self.sums[lo:hi] = s

    def solve(self, R: np.ndarray, x: np.ndarray) -> np.ndarray:
        new = np.zeros_like(x)
        if self.held:
            for j, (lo, hi) in enumerate(self.blocks):
                new[lo:hi] = self.solvers[j](R[lo:hi], x[lo:hi])
            return new
        blocks, prepare = self.blocks, self.prepare
        shared = self.table.sparkSession.sparkContext.broadcast((R, x))

        def run(batches):
            R_all, x_all = shared.value
            for batch in batches:
                out = []
                for j, s in zip(batch.column("block_id").to_pylist(), batch.column("s")):
                    lo, hi = blocks[j]
                    G = np.asarray(s.values)[hi - lo :].reshape(hi - lo, hi - lo)
                    out.append(prepare(G)(R_all[lo:hi], x_all[lo:hi]).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block_id"), pa.array(out, _DOUBLES)], names=["block_id", "s"]
                )

        for j, s in self._rows(self.table.mapInArrow(run, "block_id int, s array<double>")):
            lo, hi = blocks[j]
            new[lo:hi] = s.reshape(hi - lo, -1)
        shared.destroy()
        return new

    def close(self) -> None:
        if not self.held:
            self.table.unpersist()


# --- the rounds ------------------------------------------------------------------------------


def _round_kernel(x: np.ndarray, n_blocks: int, row_step: RowStep, start: float):
    """Kernel over chunks (with their state, but in the first round): one round of the rows.

    Gives the new ``z`` and ``u``, the part of ``X'(z - Abar - u)`` in ``r``, and in ``s``
    the sums of squares of ``Abar - z`` and of absolute changes of ``u``.
    """
    k = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, u, r, s = [], [], [], []
            has_state = "z" in batch.schema.names
            for i, A, target in chunk_matrices(batch):
                if has_state:
                    z_old, u_old = (
                        np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(A), k) for c in ("z", "u")
                    )
                else:
                    z_old = u_old = np.full((len(A), k), start)
                abar = A @ x / n_blocks
                z_new = row_step(z_old, abar, u_old, target)
                gap = abar - z_new
                u_new = u_old + gap
                z.append(z_new.tobytes())
                u.append(u_new.tobytes())
                r.append((A.T @ (-gap - u_new)).ravel())
                # the first change counts from zero, whatever the start
                moved = gap if has_state else u_new
                s.append([float((gap**2).sum()), float(np.abs(moved).sum())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk_id"),
                    pa.array(z, pa.binary()),
                    pa.array(u, pa.binary()),
                    pa.array(r, _DOUBLES),
                    pa.array(s, _DOUBLES),
                ],
                names=["chunk_id", "z", "u", "r", "s"],
            )

    return run


class _SharingRounds:
    """State per chunk ``<chunk_id, z, u>``; the driver knows x and X'(z - Abar - u) only."""

    def __init__(
        self,
        rows: DataFrame,
        num_rows: int,
        blocks: Sequence[tuple[int, int]],
        num_outputs: int,
        prepare: Callable,
        row_step: RowStep,
        start: float,
        stats_limit: int,
    ):
        p = blocks[-1][1]
        self.parts = partition_count(rows.sparkSession, num_rows * p * 8, MAX_CHUNK_BYTES)
        chunks = pack_chunks(rows).select("chunk_id", "n", "p", "X", "y")
        self.chunks = chunks.repartition(self.parts, "chunk_id").persist(_KEEP)
        self.num_rows, self.num_chunks = self.chunks.agg(F.sum("n"), F.count("*")).first()
        self.n_blocks, self.k, self.row_step, self.start = len(blocks), num_outputs, row_step, start
        self.block_step = _BlockStep(self.chunks, self.parts, blocks, prepare, stats_limit)
        self.x = np.full((p, num_outputs), start)
        self.x_checked = self.x.copy()
        self.blocks = blocks
        # z, u and Abar all start at ``start``, so z - Abar - u = -start
        self.R = np.repeat(-start * self.block_step.sums[:, None], num_outputs, axis=1)
        self.state: DataFrame | None = None
        self.primal_square = self.change = 0.0
        self._saved: DataFrame | None = None

    def advance(self) -> dict:
        self.x = self.block_step.solve(self.R, self.x)
        source = self.chunks.select("chunk_id", "p", "X", "y")
        if self.state is not None:
            source = source.join(self.state.select("chunk_id", "z", "u").hint("shuffle_hash"), "chunk_id")
        kernel = _round_kernel(self.x, self.n_blocks, self.row_step, self.start)
        new = source.mapInArrow(
            kernel, "chunk_id long, z binary, u binary, r array<double>, s array<double>"
        ).persist(_KEEP)
        total = driver_sum(new, self.num_chunks, {"r": self.x.size, "s": 2})
        self.R = total["r"].reshape(self.x.shape)
        self.primal_square, self.change = total["s"]
        self._replace(new)
        return {"diff": float(self.change / (self.num_rows * self.k))}

    def residuals(self) -> tuple[float, float]:
        primal = self.n_blocks * self.primal_square**0.5
        moved = self.x - self.x_checked
        dual = sum(float(np.linalg.norm(moved[lo:hi])) for lo, hi in self.blocks)
        self.x_checked = self.x.copy()
        return primal, dual

    def _replace(self, new: DataFrame | None) -> None:
        if self.state is not None:
            self.state.unpersist()
        self.state = new

    def cut_lineage(self) -> None:
        saved = cut_lineage(self.state.select("chunk_id", "z", "u"))
        self._replace(saved)
        drop_checkpoint(self._saved)
        self._saved = saved

    def weights(self) -> np.ndarray:
        return self.x

    def close(self) -> None:
        self._replace(None)
        drop_checkpoint(self._saved)
        self.block_step.close()
        self.chunks.unpersist()


class _LassoOnGram:
    """The lasso rounds on X'X and X'b alone.

    With squared loss ``z`` and ``u`` stay of the form ``a b + X v``, so their coefficients
    (a number and p numbers) replace the n rows.
    """

    parts = None

    def __init__(self, G, c, bb, blocks, prepare, rho):
        self.G, self.c, self.bb, self.blocks, self.rho = G, c, bb, blocks, rho
        self.solvers = [prepare(G[lo:hi, lo:hi]) for lo, hi in blocks]
        p = len(c)
        self.x, self.x_checked = np.zeros((p, 1)), np.zeros((p, 1))
        self.z_b = self.u_b = 0.0
        self.z_x, self.u_x = np.zeros((p, 1)), np.zeros((p, 1))

    def advance(self) -> None:
        n, rho = len(self.blocks), self.rho
        R = (self.z_b - self.u_b) * self.c + self.G @ (self.z_x - self.x / n - self.u_x)
        self.x = np.concatenate(
            [solve(R[lo:hi], self.x[lo:hi]) for solve, (lo, hi) in zip(self.solvers, self.blocks)]
        )
        abar = self.x / n
        self.z_b = (1 + rho * self.u_b) / (n + rho)
        self.z_x = rho * (abar + self.u_x) / (n + rho)
        self.u_b = self.u_b - self.z_b
        self.u_x = self.u_x + abar - self.z_x

    def residuals(self) -> tuple[float, float]:
        n = len(self.blocks)
        d = self.x / n - self.z_x
        square = float((d.T @ self.G @ d - 2 * self.z_b * (d.T @ self.c)).item() + self.z_b**2 * self.bb)
        moved = self.x - self.x_checked
        dual = sum(float(np.linalg.norm(moved[lo:hi])) for lo, hi in self.blocks)
        self.x_checked = self.x.copy()
        return n * max(square, 0.0) ** 0.5, dual

    def cut_lineage(self) -> None:
        pass

    def weights(self) -> np.ndarray:
        return self.x

    def close(self) -> None:
        pass


# --- trainers --------------------------------------------------------------------------------


def sharing_lasso(
    df: DataFrame,
    lam: float = 0.5,
    rho: float = 0.2,
    num_blocks: int = 2,
    max_iter: int = 100,
    tol: float = 0.01,
    x_step: str = "exact",
    policy: str = "ceil",
    check_every: int = 5,
    checkpoint_every: int = 5,
    stats_limit: int = STATS_LIMIT,
) -> Model:
    """Feature-split ADMM for ``min |X x - b|^2 / 2 + lam |x|_1``.

    The data is read once when X'X fits ``stats_limit``; otherwise once per round.
    ``x_step="closed_form"`` is exact for orthogonal columns within a block only.
    """
    params = dict(lam=lam, rho=rho, num_blocks=num_blocks, max_iter=max_iter, tol=tol, x_step=x_step)
    p = num_features(df)
    blocks = feature_blocks(p, num_blocks, policy)
    prepare = lasso_solver(lam, rho, x_step)
    if p * p * 8 <= stats_limit:
        row = gram(df.drop("block_id"), p).first()
        G = np.array(row["gram"]).reshape(p, p)
        problem = _LassoOnGram(G, np.array(row["cross"]).reshape(p, 1), row["yy"], blocks, prepare, rho)
    else:
        rows = with_label(df.drop("block_id"))
        row_step = squared_rows(num_blocks, rho)
        problem = _SharingRounds(rows, rows.count(), blocks, 1, prepare, row_step, 0.0, stats_limit)
    with fixed_plans(df.sparkSession, problem.parts):
        x, history = run_admm(problem, max_iter, tol, check_every, checkpoint_every)
    return Model(df.sparkSession, x, history_rows=history, params=params)


def sharing_smlr(
    df: DataFrame,
    lam: float = 0.5,
    rho: float = 0.2,
    alpha: float = 0.01,
    num_blocks: int = 2,
    max_iter: int = 100,
    tol: float = 0.01,
    inner_iter: int = 50,
    inner_tol: float | None = None,
    z_steps: int = 199,
    policy: str = "ceil",
    check_every: int = 5,
    checkpoint_every: int = 5,
    stats_limit: int = STATS_LIMIT,
) -> Model:
    """Sparse multinomial regression (no bias) by feature-split ADMM."""
    params = dict(lam=lam, rho=rho, alpha=alpha, num_blocks=num_blocks, max_iter=max_iter)
    rows, classes, num_rows = indexed(df.drop("block_id"))
    blocks = feature_blocks(num_features(rows), num_blocks, policy)
    problem = _SharingRounds(
        rows,
        num_rows,
        blocks,
        len(classes),
        sparse_solver(lam, rho, inner_iter, inner_tol),
        softmax_adam_rows(num_blocks, rho, alpha, z_steps),
        0.0,
        stats_limit,
    )
    with fixed_plans(df.sparkSession, problem.parts):
        x, history = run_admm(problem, max_iter, tol, check_every, checkpoint_every)
    return Model(df.sparkSession, x, classes, history_rows=history, params=params)


def umlr_sharing(
    df: DataFrame,
    num_blocks: int = 4,
    epsilon: float = 0.01,
    rho: float = 0.01,
    eta: float = 1e-5,
    epochs: int = 100,
    tol: float = -1.0,
    policy: str = "balanced",
    checkpoint_every: int = 5,
    stats_limit: int = STATS_LIMIT,
) -> Model:
    """Maximal-uncorrelated multinomial regression (no bias) by feature-split ADMM."""
    params = dict(num_blocks=num_blocks, epsilon=epsilon, rho=rho, eta=eta, epochs=epochs)
    rows, classes, num_rows = indexed(df.drop("block_id"))
    blocks = feature_blocks(num_features(rows), num_blocks, policy)
    problem = _SharingRounds(
        rows,
        num_rows,
        blocks,
        len(classes),
        ridge_solver(eta, rho),
        softmax_gradient_rows(num_blocks, rho, epsilon),
        1.0,
        stats_limit,
    )
    with fixed_plans(df.sparkSession, problem.parts):
        x, history = run_admm(problem, epochs, tol, checkpoint_every=checkpoint_every)
    return Model(df.sparkSession, x, classes, history_rows=history, params=params)
