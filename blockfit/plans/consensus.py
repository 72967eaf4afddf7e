"""Consensus trainers: every row block has its own weights, pulled to a common ``z``.

The block states are ``N * p * K`` numbers. Below ``stats_limit`` they travel with the
jobs, which then need one stage per round and no join; above it they are a table that is
joined to the data, and only ``z`` is known to the driver. Both ways give the same rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockfit.functions.arrays import collect_sum
from blockfit.model import Model
from blockfit.operators.blocks import MAX_CHUNK_BYTES, chunk_matrices, pack_chunks, row_blocks
from blockfit.operators.linalg import (
    PARTIALS_LIMIT,
    block_median,
    driver_sum,
    gram,
    vector_sum,
)
from blockfit.operators.prepare import with_bias
from blockfit.plans.kernels import (
    AdamMoments,
    scaled_inverse,
    soft,
    softmax_residual,
    softmax_terms,
    uncorrelated_coefficients,
)
from blockfit.plans.resume import SavedRounds
from blockfit.plans.rounds import STATS_LIMIT, indexed, num_features, run_admm
from blockfit.session import cut_lineage, drop_checkpoint, fixed_plans, partition_count

_DOUBLES = pa.list_(pa.float64())
_KEEP = StorageLevel.MEMORY_AND_DISK
MAX_BLOCK_BYTES = 256 << 20
_STATE_SCHEMA = "block_id long, x array<double>, u array<double>"


def _blocked(df: DataFrame, num_blocks: int, block_by: str) -> DataFrame:
    return df if "block_id" in df.columns else row_blocks(df, num_blocks, by=block_by)


def _require_blocks(found: int, num_blocks: int) -> None:
    if found != num_blocks:
        raise ValueError(f"{found} of {num_blocks} blocks have rows; choose num_blocks to match")


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _saved(df: DataFrame, folder: str | None, params: dict) -> SavedRounds | None:
    """The rounds kept in ``folder``; how many rounds are wanted in all may change from fit to fit."""
    fixed = {k: v for k, v in params.items() if k not in ("max_iter", "epochs")}
    return SavedRounds(df.sparkSession, folder, fixed) if folder else None


class _MeanResiduals:
    """Residuals of consensus states held as one array ``(N, ...)``."""

    def _init_residuals(self, shape, num_blocks: int, rho: float) -> None:
        self._bar_before = np.zeros(shape)
        self._factor = num_blocks * rho**2

    def residuals(self) -> tuple[float, float]:
        bar = self.mean_x()
        primal = self.spread(bar)
        dual = self._factor * np.linalg.norm(bar - self._bar_before)
        self._bar_before = bar
        return primal, float(dual)


class _HeldStates(_MeanResiduals):
    """States ``x`` and ``u`` as arrays on the driver."""

    parts: int | None = None

    def mean_x(self) -> np.ndarray:
        return self.x.mean(axis=0)

    def spread(self, bar: np.ndarray) -> float:
        d = (self.x - bar).reshape(len(self.x), -1)
        return float(np.linalg.norm(d, axis=1).sum())

    def cut_lineage(self) -> None:
        pass

    def weights(self) -> np.ndarray:
        return self.z

    def close(self) -> None:
        pass


class _StateTable(_MeanResiduals):
    """States as a table ``<block_id, x, u>``, cached each round and now and then checkpointed."""

    state: DataFrame | None = None
    _saved: DataFrame | None = None

    def _replace(self, new: DataFrame) -> None:
        if self.state is not None:
            self.state.unpersist()
        self.state = new

    def mean_x(self) -> np.ndarray:
        return self._x_bar

    def spread(self, bar: np.ndarray) -> float:
        flat = bar.ravel()

        def run(batches):
            for batch in batches:
                d = [float(np.linalg.norm(np.asarray(v.values) - flat)) for v in batch.column("x")]
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64())], names=["d"])

        return self.state.select("x").mapInArrow(run, "d double").agg(F.sum("d")).first()[0]

    def cut_lineage(self) -> None:
        saved = cut_lineage(self.state)
        self._replace(saved)
        drop_checkpoint(self._saved)
        self._saved = saved

    def take_state(self, kept: DataFrame) -> None:
        """Go on with states kept elsewhere, which may be deleted later."""
        self._replace(kept)
        self.cut_lineage()

    def weights(self) -> np.ndarray:
        return self.z

    def close(self) -> None:
        self._replace(None)
        drop_checkpoint(self._saved)
        self.data.unpersist()


# --- lasso -----------------------------------------------------------------------------


class _LassoHeld(_HeldStates):
    def __init__(self, blocks: DataFrame, p: int, num_blocks: int, lam: float, rho: float):
        table = blocks.select("block_id", "gram", "cross").toArrow().sort_by("block_id")
        _require_blocks(table.num_rows, num_blocks)
        G = np.array([np.asarray(g.values) for g in table["gram"]]).reshape(-1, p, p)
        self.c = np.array([np.asarray(c.values) for c in table["cross"]])
        self.M = scaled_inverse(G, 1.0, rho)
        self.x, self.u = np.zeros((num_blocks, p)), np.zeros((num_blocks, p))
        self.z, self.rho, self.k = np.zeros(p), rho, lam / (num_blocks * rho)
        self._init_residuals(p, num_blocks, rho)

    def advance(self) -> None:
        right = self.c + self.rho * (self.z - self.u)
        self.x = np.einsum("nij,nj->ni", self.M, right)
        self.z = soft(self.x.mean(axis=0) + self.u.mean(axis=0), self.k)
        self.u = self.u + self.x - self.z


def _factors(rho: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inverses = []
            for g in batch.column("gram"):
                p = int(round(len(g.values) ** 0.5))
                inverses.append(scaled_inverse(np.asarray(g.values).reshape(p, p), 1.0, rho).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block_id"), pa.array(inverses, pa.binary()), batch.column("cross")],
                names=["block_id", "inverse", "cross"],
            )

    return run


def _state_batch(block_ids, **columns) -> pa.RecordBatch:
    arrays = [pa.array(v, _DOUBLES) for v in columns.values()]
    return pa.RecordBatch.from_arrays([block_ids, *arrays], names=["block_id", *columns])


def _lasso_round(z: np.ndarray, rho: float):
    """Kernel over blocks joined to their states.

    The dual step of a round is taken at the start of the next one, with the ``z`` known then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, us = [], []
            for m, c, x, u in zip(*(batch.column(n) for n in ("inverse", "cross", "x", "u"))):
                dual = np.asarray(u.values) + np.asarray(x.values) - z
                M = np.frombuffer(m.as_buffer()).reshape(len(z), len(z))
                xs.append(M @ (np.asarray(c.values) + rho * (z - dual)))
                us.append(dual)
            yield _state_batch(batch.column("block_id"), x=xs, u=us)

    return run


class _LassoTable(_StateTable):
    def __init__(self, blocks: DataFrame, p: int, num_blocks: int, lam: float, rho: float):
        self.parts = partition_count(blocks.sparkSession, num_blocks * p * p * 8, MAX_CHUNK_BYTES)
        self.data = (
            blocks.select("block_id", "gram", "cross")
            .mapInArrow(_factors(rho), "block_id long, inverse binary, cross array<double>")
            .repartition(self.parts, "block_id")
            .persist(_KEEP)
        )
        _require_blocks(self.data.count(), num_blocks)
        zeros = F.array_repeat(F.lit(0.0), p)
        self.state = self.data.select("block_id", zeros.alias("x"), zeros.alias("u")).persist(_KEEP)
        self.p, self.n, self.rho, self.k = p, num_blocks, rho, lam / (num_blocks * rho)
        self.z = np.zeros(p)
        self._init_residuals(p, num_blocks, rho)

    def advance(self) -> None:
        joined = self.data.join(self.state.select("block_id", "x", "u").hint("shuffle_hash"), "block_id")
        new = joined.mapInArrow(_lasso_round(self.z, self.rho), _STATE_SCHEMA).persist(_KEEP)
        total = driver_sum(new, self.n, {"x": self.p, "u": self.p})
        self._x_bar = total["x"] / self.n
        self.z = soft(self._x_bar + total["u"] / self.n, self.k)
        self._replace(new)


def consensus_lasso(
    df: DataFrame,
    lam: float = 0.5,
    rho: float = 0.2,
    num_blocks: int = 2,
    max_iter: int = 100,
    tol: float = 0.01,
    check_every: int = 5,
    checkpoint_every: int = 5,
    block_by: str = "hash",
    stats_limit: int = STATS_LIMIT,
    resume: str | None = None,
) -> Model:
    """Row-split ADMM for ``min sum_i |A_i x - b_i|^2 / 2 + lam |x|_1``, without intercept.

    The data is read once, for the Gram statistics of the blocks; a round touches only
    these. ``df`` may bring its own ``block_id``. With ``resume``, a shared folder, the fit goes on after the
    last round kept there.
    """
    params = dict(lam=lam, rho=rho, num_blocks=num_blocks, max_iter=max_iter, tol=tol)
    p = num_features(df)
    blocks = gram(_blocked(df, num_blocks, block_by), p, num_blocks)
    held = num_blocks * (p * p + 3 * p) * 8 <= stats_limit
    problem = (_LassoHeld if held else _LassoTable)(blocks, p, num_blocks, lam, rho)
    with fixed_plans(df.sparkSession, problem.parts):
        z, history = run_admm(problem, max_iter, tol, check_every, checkpoint_every, _saved(df, resume, params))
    return Model(df.sparkSession, z.reshape(-1, 1), history_rows=history, params=params)


# --- multinomial trainers --------------------------------------------------------------


def _gradient_partials(states: np.ndarray):
    """Kernel: per partition and block one gradient sum at the weights of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = batch.column("block_id")
            for i, X, y in chunk_matrices(batch):
                b = blocks[i].as_py()
                g, _ = softmax_terms(X, y.astype(np.int64), states[b])
                held[b] = held[b] + g if b in held else g
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([g.ravel() for g in held.values()], _DOUBLES)],
            names=["block_id", "g"],
        )

    return run


def block_gradients(chunks: DataFrame, states: np.ndarray, parts: int) -> np.ndarray:
    """``A_i' (softmax(A_i x_i) - Y_i)`` of every block, in one pass over chunks in ``parts`` partitions."""
    # Spark itself broadcasts a kernel that carries more than a megabyte
    partials = chunks.select("block_id", "p", "X", "y").mapInArrow(
        _gradient_partials(states), "block_id long, g array<double>"
    )
    # a partition meets few blocks: together about one partial per block and partition
    if (parts + len(states)) * states[0].nbytes > PARTIALS_LIMIT:
        partials = vector_sum(
            partials, "g", ["block_id"], width=states[0].size, num_partials=parts, num_groups=len(states)
        )
    table = partials.toArrow()
    out = np.zeros_like(states)
    for b, g in zip(table["block_id"].to_pylist(), table["g"]):
        out[b] += np.asarray(g.values).reshape(states.shape[1:])
    return out


def _local_adam(X, y, x, z, u, rho, alpha, steps) -> np.ndarray:
    adam = AdamMoments(x.shape, alpha)
    x = x.copy()
    for _ in range(steps):
        x -= adam.step(X.T @ softmax_residual(X @ x, y) + rho * (x - z + u))
    return x


class _SparseHeld(_HeldStates):
    """Local Adam per block; a block is one chunk, unless blocks are too large for a worker.

    Then every local step is a pass over the chunks that sums the gradient of a block.
    """

    def __init__(self, chunks, parts, shape, num_blocks, lam, rho, alpha, steps, consensus, whole):
        self.chunks, self.parts, self.whole, self.consensus = chunks, parts, whole, consensus
        self.rho, self.alpha, self.steps, self.k = rho, alpha, steps, lam / (num_blocks * rho)
        self.x, self.u = np.zeros((num_blocks, *shape)), np.zeros((num_blocks, *shape))
        self.z = np.zeros(shape)
        self._init_residuals(shape, num_blocks, rho)

    def _local_steps(self) -> np.ndarray:
        if not self.whole:
            x, adam = self.x.copy(), AdamMoments(self.x.shape, self.alpha)
            for _ in range(self.steps):
                x -= adam.step(block_gradients(self.chunks, x, self.parts) + self.rho * (x - self.z + self.u))
            return x
        xs, us, z, rho, alpha, steps = self.x, self.u, self.z, self.rho, self.alpha, self.steps

        def run(batches):
            for batch in batches:
                ids = batch.column("block_id").to_pylist()
                new = [
                    _local_adam(X, y.astype(np.int64), xs[ids[i]], z, us[ids[i]], rho, alpha, steps).ravel()
                    for i, X, y in chunk_matrices(batch)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block_id"), pa.array(new, _DOUBLES)], names=["block_id", "x"]
                )

        out = self.chunks.select("block_id", "p", "X", "y").mapInArrow(run, "block_id long, x array<double>")
        table = out.toArrow()
        x = np.zeros_like(self.x)
        for b, v in zip(table["block_id"].to_pylist(), table["x"]):
            x[b] = np.asarray(v.values).reshape(x.shape[1:])
        return x

    def advance(self) -> None:
        self.x = self._local_steps()
        s = self.x + self.u
        middle = np.sort(s, axis=0)[len(s) // 2] if self.consensus == "median" else s.mean(axis=0)
        self.z = soft(middle, self.k)
        self.u = self.u + self.x - self.z

    def close(self) -> None:
        self.chunks.unpersist()


def _sparse_round(z: np.ndarray, rho: float, alpha: float, steps: int):
    """Kernel over whole blocks joined to their states; the dual step comes first, as for the lasso."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, us = [], []
            for i, A, labels in chunk_matrices(batch):
                old, dual = (np.asarray(batch.column(c)[i].values).reshape(z.shape) for c in ("w", "u"))
                dual = dual + old - z
                xs.append(_local_adam(A, labels.astype(np.int64), old, z, dual, rho, alpha, steps).ravel())
                us.append(dual.ravel())
            yield _state_batch(batch.column("block_id"), x=xs, u=us, s=[a + b for a, b in zip(xs, us)])

    return run


class _SparseTable(_StateTable):
    """As above with the states in a table next to the blocks; neither side is exchanged."""

    def __init__(self, chunks, parts, shape, num_blocks, lam, rho, alpha, steps, consensus):
        self.parts = parts
        self.data, self.shape, self.n, self.consensus = chunks, shape, num_blocks, consensus
        self.rho, self.alpha, self.steps, self.k = rho, alpha, steps, lam / (num_blocks * rho)
        zeros = F.array_repeat(F.lit(0.0), int(np.prod(shape)))
        self.state = chunks.select("block_id", zeros.alias("x"), zeros.alias("u")).persist(_KEEP)
        self.z = np.zeros(shape)
        self._init_residuals(shape, num_blocks, rho)

    def advance(self) -> None:
        state = self.state.select("block_id", F.col("x").alias("w"), "u").hint("shuffle_hash")
        joined = self.data.select("block_id", "X", "p", "y").join(state, "block_id")
        kernel = _sparse_round(self.z, self.rho, self.alpha, self.steps)
        new = joined.mapInArrow(kernel, _STATE_SCHEMA + ", s array<double>").persist(_KEEP)
        size = int(np.prod(self.shape))
        total = driver_sum(new, self.n, {"x": size, "s": size})
        self._x_bar = (total["x"] / self.n).reshape(self.shape)
        if self.consensus == "median":
            middle = np.zeros(size)
            medians = block_median(new, "s").toArrow()
            middle[medians["pos"].to_numpy()] = medians["value"].to_numpy()
        else:
            middle = total["s"] / self.n
        self.z = soft(middle.reshape(self.shape), self.k)
        self._replace(new)


def _pass_step(z: np.ndarray, rho: float, alpha: float, t: int):
    """Kernel over blocks with gradient, state and moments: local step ``t``.

    The dual step comes before the first one, which starts with moments of zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in "xumv"}
            for row in zip(*(batch.column(c) for c in ("g", "x", "u", "m", "v"))):
                g, old, dual, m, v = (np.asarray(value.values) for value in row)
                adam = AdamMoments(z.shape, alpha)
                if t == 0:
                    dual = dual + old - z
                else:
                    adam.m, adam.v, adam.t = m.copy(), v.copy(), t
                new = old - adam.step(g + rho * (old - z + dual))
                for c, value in zip("xumv", (new, dual, adam.m, adam.v)):
                    out[c].append(value)
            yield _state_batch(batch.column("block_id"), **out)

    return run


class _SparsePasses(_StateTable):
    """Blocks too large for a worker, and states too large for the driver: local steps are passes.

    A step sends the weights of the blocks to their chunks, which lie where they are, adds the partial gradients
    in a tree and moves the state, with the moments of Adam, in a table of one row per block. The state is
    checkpointed in every step, so a lost executor costs a step at most.
    """

    def __init__(self, chunks, parts, shape, num_blocks, lam, rho, alpha, steps, consensus):
        self.parts, self.shape, self.n, self.consensus = parts, shape, num_blocks, consensus
        self.rho, self.alpha, self.steps, self.k = rho, alpha, steps, lam / (num_blocks * rho)
        self.size = int(np.prod(shape))
        self.data, self.salts = _place_chunks(chunks.persist(_KEEP), parts)
        zeros = F.array_repeat(F.lit(0.0), self.size)
        blocks = self.data.select("block_id").distinct()
        self._store(blocks.select("block_id", *[zeros.alias(c) for c in "xumv"]))
        chunks.unpersist()
        self.z = np.zeros(shape)
        self._init_residuals(shape, num_blocks, rho)

    def take_state(self, kept: DataFrame) -> None:
        self._store(kept)

    def _store(self, new: DataFrame) -> None:
        before, self._saved = self._saved, cut_lineage(new)
        self.state = self._saved
        drop_checkpoint(before)

    def advance(self) -> None:
        schema = _STATE_SCHEMA + ", m array<double>, v array<double>"
        for t in range(self.steps):
            partials = _with_states(self.data, self.salts, self.state).mapInArrow(
                _joined_gradients(self.shape, with_state=False), "block_id long, g array<double>"
            )
            sums = vector_sum(
                partials, "g", ["block_id"], width=self.size, num_partials=self.parts, num_groups=self.n
            )
            kernel = _pass_step(self.z.ravel(), self.rho, self.alpha, t)
            self._store(self.state.join(sums, "block_id").mapInArrow(kernel, schema))
        s = F.zip_with("x", "u", lambda a, b: a + b).alias("s")
        moved = self.state.select("block_id", "x", s)
        total = driver_sum(moved, self.n, {"x": self.size, "s": self.size})
        self._x_bar = (total["x"] / self.n).reshape(self.shape)
        if self.consensus == "median":
            middle = np.zeros(self.size)
            medians = block_median(moved, "s").toArrow()
            middle[medians["pos"].to_numpy()] = medians["value"].to_numpy()
        else:
            middle = total["s"] / self.n
        self.z = soft(middle.reshape(self.shape), self.k)

    def cut_lineage(self) -> None:
        """Every step does."""


def consensus_smlr(
    df: DataFrame,
    lam: float = 0.5,
    rho: float = 0.2,
    alpha: float = 0.001,
    num_blocks: int = 2,
    max_iter: int = 100,
    tol: float = 0.01,
    local_steps: int = 49,
    consensus: str = "median",
    check_every: int = 5,
    checkpoint_every: int = 5,
    block_by: str = "hash",
    max_block_bytes: int = MAX_BLOCK_BYTES,
    stats_limit: int = STATS_LIMIT,
    resume: str | None = None,
) -> Model:
    """Sparse multinomial regression (with bias) by row-split ADMM and a robust consensus.

    Every block takes ``local_steps`` Adam steps of its own; ``z`` is the soft-thresholded
    upper median (or mean) of the block states per coordinate. A block up to ``max_block_bytes`` takes its steps in
    one task; larger ones take the same steps by passes over their chunks, with the states on the driver up to
    ``stats_limit`` and in a table beyond.
    """
    if consensus not in ("median", "mean"):
        raise ValueError(f"unknown consensus {consensus!r}")
    params = dict(lam=lam, rho=rho, alpha=alpha, num_blocks=num_blocks, consensus=consensus, max_iter=max_iter)
    spark = df.sparkSession
    rows, classes, num_rows = indexed(_blocked(df, num_blocks, block_by))
    rows = with_bias(rows)
    p = num_features(rows)
    shape = (p, len(classes))
    sizes = rows.groupBy("block_id").count()
    largest, found, last = sizes.agg(F.max("count"), F.count("*"), F.max("block_id")).first()
    _require_blocks(found, num_blocks)
    whole = largest * p * 8 <= max_block_bytes
    held = 3 * num_blocks * shape[0] * shape[1] * 8 <= stats_limit and last < num_blocks
    parts = partition_count(spark, num_rows * p * 8, MAX_CHUNK_BYTES)
    if whole:
        # local steps are all the work, so a block per task if the session has the partitions
        parts = max(parts, min(num_blocks, _shuffle_partitions(df)))
    chunks = pack_chunks(
        rows, parts, max_block_bytes if whole else MAX_CHUNK_BYTES, whole_blocks=whole, num_rows=num_rows
    )
    if held:
        problem = _SparseHeld(
            chunks.persist(_KEEP), parts, shape, num_blocks, lam, rho, alpha, local_steps, consensus, whole
        )
    elif not whole:
        problem = _SparsePasses(chunks, parts, shape, num_blocks, lam, rho, alpha, local_steps, consensus)
    else:
        placed = chunks.repartition(parts, "block_id").persist(_KEEP)
        problem = _SparseTable(placed, parts, shape, num_blocks, lam, rho, alpha, local_steps, consensus)
    with fixed_plans(spark, problem.parts):
        z, history = run_admm(problem, max_iter, tol, check_every, checkpoint_every, _saved(df, resume, params))
    return Model(spark, z, classes, bias=True, history_rows=history, params=params)


def _umlr_z(z: np.ndarray, bar: np.ndarray, n: int, rho: float, eta: float) -> np.ndarray:
    return rho * n * bar / (eta * uncorrelated_coefficients(z) + n * rho)


class _UncorrelatedHeld(_HeldStates):
    def __init__(self, chunks, parts, shape, num_blocks, num_rows, epsilon, rho, eta):
        self.chunks, self.parts, self.scale = chunks, parts, num_blocks / num_rows
        self.epsilon, self.rho, self.eta = epsilon, rho, eta
        self.x, self.u = np.ones((num_blocks, *shape)), np.ones((num_blocks, *shape))
        self.z = np.ones(shape)
        self._init_residuals(shape, num_blocks, rho)
        self._z_before = np.zeros(shape)

    def advance(self) -> dict:
        g = self.scale * block_gradients(self.chunks, self.x, self.parts) + self.rho * (self.x - self.z + self.u)
        self.u = self.u + self.x - self.z
        self.x = self.x - self.epsilon * g
        self.z = _umlr_z(self.z, self.x.mean(axis=0) + self.u.mean(axis=0), len(self.x), self.rho, self.eta)
        diff = float(np.abs(self.z - self._z_before).mean())
        self._z_before = self.z
        return {"diff": diff}

    def close(self) -> None:
        self.chunks.unpersist()


def _joined_gradients(shape, with_state: bool = True):
    """Kernel over chunks joined to states: partial gradient, next to the state, per partition and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        limit = max(1, (64 << 20) // (3 * 8 * shape[0] * shape[1]))

        def out():
            names = ["g", "x", "u"] if with_state else ["g"]
            columns = list(zip(*held.values()))[: len(names)]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), *[pa.array(list(c), _DOUBLES) for c in columns]],
                names=["block_id", *names],
            )

        for batch in batches:
            for i, X, y in chunk_matrices(batch):
                b = batch.column("block_id")[i].as_py()
                if b not in held:
                    if len(held) >= limit:
                        yield out()
                        held.clear()
                    x, u = (np.asarray(batch.column(c)[i].values) for c in ("w", "u"))
                    held[b] = [np.zeros(x.size), x, u]
                g, _ = softmax_terms(X, y.astype(np.int64), held[b][1].reshape(shape))
                held[b][0] = held[b][0] + g.ravel()
        if held:
            yield out()

    return run


def _uncorrelated_round(z: np.ndarray, scale: float, rho: float, epsilon: float):
    """Kernel over blocks with gradient and state: the dual step, then the gradient step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, us = [], []
            for row in zip(*(batch.column(n) for n in ("g", "x", "u"))):
                g, old, dual = (np.asarray(v.values) for v in row)
                us.append(dual + old - z)
                xs.append(old - epsilon * (scale * g + rho * (old - z + dual)))
            yield _state_batch(batch.column("block_id"), x=xs, u=us)

    return run


def _place_chunks(chunks: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Chunks put into their partitions once, by ``(block_id, salt)``, and the salts of the blocks.

    A block has one salt for each partition's worth of chunks, so that a hot one fills many.
    Returns the persisted chunks and ``<block_id, _salts>`` of the blocks that have several.
    """
    counts = chunks.groupBy("block_id").agg(F.count("*").alias("_chunks"))
    per_part = max(1, -(-(counts.agg(F.sum("_chunks")).first()[0] or 0) // parts))
    # blocks above the mean partition: fewer than there are partitions
    hot = [(r["block_id"], -(-r["_chunks"] // per_part)) for r in counts.filter(F.col("_chunks") > per_part).collect()]
    salts = chunks.sparkSession.createDataFrame(hot, "block_id long, _salts long")
    salt = F.pmod(F.xxhash64("chunk_id"), F.coalesce("_salts", F.lit(1)))
    salted = chunks.join(F.broadcast(salts), "block_id", "left").withColumn("salt", salt).drop("_salts")
    return salted.repartition(parts, "block_id", "salt").persist(_KEEP), salts


def _with_states(data: DataFrame, salts: DataFrame, states: DataFrame) -> DataFrame:
    """Placed chunks, where they lie, with the state of their block; only the state moves."""
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
    state = states.select("block_id", F.col("x").alias("w"), "u")
    state = state.join(F.broadcast(salts), "block_id", "left").withColumn("salt", F.explode(every))
    chunks = data.select("block_id", "salt", "p", "X", "y")
    return chunks.join(state.drop("_salts").hint("shuffle_hash"), ["block_id", "salt"]).drop("salt")


class _UncorrelatedTable(_StateTable):
    def __init__(self, chunks, parts, shape, num_blocks, num_rows, epsilon, rho, eta):
        self.shape, self.n, self.scale = shape, num_blocks, num_blocks / num_rows
        self.epsilon, self.rho, self.eta = epsilon, rho, eta
        self.data, self.salts = _place_chunks(chunks, parts)
        ones = F.array_repeat(F.lit(1.0), int(np.prod(shape)))
        self.state = self.data.select("block_id").distinct().select("block_id", ones.alias("x"), ones.alias("u"))
        self.state = self.state.persist(_KEEP)
        self.state.count()
        chunks.unpersist()
        self.z, self._z_before = np.ones(shape), np.zeros(shape)
        self._init_residuals(shape, num_blocks, rho)

    def joined(self) -> DataFrame:
        return _with_states(self.data, self.salts, self.state)

    def advance(self) -> dict:
        sums = (
            self.joined().mapInArrow(
                _joined_gradients(self.shape), "block_id long, g array<double>, x array<double>, u array<double>"
            )
            .groupBy("block_id")
            .agg(collect_sum("g").alias("g"), F.first("x").alias("x"), F.first("u").alias("u"))
        )
        kernel = _uncorrelated_round(self.z.ravel(), self.scale, self.rho, self.epsilon)
        new = sums.mapInArrow(kernel, _STATE_SCHEMA).persist(_KEEP)
        size = int(np.prod(self.shape))
        total = driver_sum(new, self.n, {"x": size, "u": size})
        self._x_bar = (total["x"] / self.n).reshape(self.shape)
        bar = self._x_bar + (total["u"] / self.n).reshape(self.shape)
        self.z = _umlr_z(self.z, bar, self.n, self.rho, self.eta)
        self._replace(new)
        diff = float(np.abs(self.z - self._z_before).mean())
        self._z_before = self.z
        return {"diff": diff}


def umlr_consensus(
    df: DataFrame,
    epsilon: float = 0.01,
    rho: float = 0.01,
    eta: float = 1e-5,
    num_blocks: int = 4,
    epochs: int = 100,
    tol: float = -1.0,
    checkpoint_every: int = 5,
    block_by: str = "hash",
    stats_limit: int = STATS_LIMIT,
    resume: str | None = None,
) -> Model:
    """Maximal-uncorrelated multinomial regression by row-split ADMM with one gradient step per round.

    With ``resume``, a shared folder, the fit goes on after the last round kept there.
    """
    params = dict(epsilon=epsilon, rho=rho, eta=eta, num_blocks=num_blocks, epochs=epochs)
    spark = df.sparkSession
    rows, classes, num_rows = indexed(_blocked(df, num_blocks, block_by))
    shape = (num_features(rows), len(classes))
    parts = partition_count(spark, num_rows * shape[0] * 8, MAX_CHUNK_BYTES)
    chunks = pack_chunks(rows, parts, num_rows=num_rows).persist(_KEEP)
    found, last = chunks.agg(F.count_distinct("block_id"), F.max("block_id")).first()
    _require_blocks(found, num_blocks)
    held = 3 * num_blocks * shape[0] * shape[1] * 8 <= stats_limit and last < num_blocks
    kind = _UncorrelatedHeld if held else _UncorrelatedTable
    problem = kind(chunks, parts, shape, num_blocks, num_rows, epsilon, rho, eta)
    with fixed_plans(spark, parts):
        z, history = run_admm(problem, epochs, tol, checkpoint_every=checkpoint_every, saved=_saved(df, resume, params))
    return Model(spark, z, classes, history_rows=history, params=params)
