"""Gradient trainers: least squares and multinomial regression, full-batch or by minibatch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from blockfit.model import Model
from blockfit.operators.blocks import pack_chunks
from blockfit.operators.linalg import (
    driver_sum,
    gram,
    ls_partials,
    softmax_partials,
    softmax_row_partials,
    umlr_penalty,
    with_label,
)
from blockfit.operators.prepare import with_row_id
from blockfit.plans.kernels import AdamMoments, uncorrelated_coefficients
from blockfit.plans.rounds import STATS_LIMIT, indexed, num_features
from blockfit.session import fixed_plans

_KEEP = StorageLevel.MEMORY_AND_DISK


def _cached_chunks(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Chunks packed where the rows are, with the number of rows and of partitions."""
    chunks = pack_chunks(rows, sort=False).persist(_KEEP)
    n, parts = chunks.withColumn("_part", F.spark_partition_id()).agg(F.sum("n"), F.max("_part") + 1).first()
    if not n:
        raise ValueError("no row to fit")
    return chunks, n, parts


# --- least squares ---------------------------------------------------------------------------


def least_squares_gd(
    df: DataFrame, lr: float = 1e-3, epochs: int = 100, stats_limit: int = STATS_LIMIT
) -> Model:
    """Full-batch gradient descent on ``sum (x.w - y)^2 / 2`` from zero, without intercept.

    Diverges for ``lr > 2 / lambda_max(X'X)``. While X'X fits ``stats_limit`` the data is
    read once and the epochs use X'X and X'y; otherwise every epoch reads the cached chunks.
    """
    p = num_features(df)
    w, history = np.zeros(p), []
    if p * p * 8 <= stats_limit:
        row = gram(df.drop("block_id"), p).first()
        G, c = np.array(row["gram"]).reshape(p, p), np.array(row["cross"])
        gradient: Callable = lambda w: G @ w - c
        chunks = None
    else:
        chunks, _, parts = _cached_chunks(with_label(df.drop("block_id")))
        source = chunks.select("p", "X", "y")

        def gradient(w):
            return driver_sum(source.mapInArrow(ls_partials(w), "g array<double>"), parts, {"g": p})["g"]

    with fixed_plans(df.sparkSession):
        for t in range(epochs):
            step = lr * gradient(w)
            w = w - step
            history.append({"round": t, "diff": float(np.abs(step).mean())})
    if chunks is not None:
        chunks.unpersist()
    params = dict(lr=lr, epochs=epochs)
    return Model(df.sparkSession, w.reshape(-1, 1), history_rows=history, params=params)


# --- multinomial, full batch -----------------------------------------------------------------


def _sums(partials: DataFrame, num_partials: int, W: np.ndarray) -> tuple[float, float, np.ndarray]:
    """``(rows, loss sum, gradient sum)``."""
    s = driver_sum(partials, num_partials, {"s": W.size + 2})["s"]
    return s[0], s[1], s[2:].reshape(W.shape)


def umlr_adam(
    df: DataFrame,
    lr: float = 0.01,
    eta: float = 1e-5,
    epochs: int = 100,
    beta1: float = 0.9,
    beta2: float = 0.9999,
    eps: float = 1e-8,
    penalty_scale: str = "per_row",
) -> Model:
    """Maximal-uncorrelated multinomial regression by full-batch Adam on the summed gradient.

    ``penalty_scale="per_row"`` counts the penalty once for every row, ``"once"`` only once.
    """
    rows, classes, _ = indexed(df.drop("block_id"))
    chunks, n, parts = _cached_chunks(rows)
    source = chunks.select("p", "X", "y")
    W = np.zeros((num_features(df), len(classes)))
    adam = AdamMoments(W.shape, lr, beta1, beta2, eps)
    weight = eta * (n if penalty_scale == "per_row" else 1)
    history = []
    with fixed_plans(df.sparkSession):
        for t in range(epochs):
            _, loss, g = _sums(source.mapInArrow(softmax_partials(W), "s array<double>"), parts, W)
            step = adam.corrected_step(g + weight * W * uncorrelated_coefficients(W))
            W = W - step
            history.append({"round": t, "diff": float(np.abs(step).mean()), "loss": loss / n})
    chunks.unpersist()
    params = dict(lr=lr, eta=eta, epochs=epochs, penalty_scale=penalty_scale)
    return Model(df.sparkSession, W, classes, history_rows=history, params=params)


# --- batches -----------------------------------------------------------------------------------


_BITS = 12
_LAST_FETCH = 50_000


def _hash_cut(hashes: DataFrame, k: int) -> int:
    """The ``k``-th smallest value of the long column ``h`` of a hash.

    Counts by the leading bits, 12 more per pass, until the bin around the rank is small.
    """
    shift, prefix = 64 - _BITS, None
    while True:
        bins = hashes if prefix is None else hashes.filter(F.shiftright("h", shift + _BITS) == prefix)
        counts = bins.groupBy(F.shiftright("h", shift).alias("bin")).count().collect()
        for row in sorted(counts):
            if k <= row["count"]:
                break
            k -= row["count"]
        prefix = row["bin"]
        if row["count"] <= _LAST_FETCH or shift < _BITS:
            break
        shift -= _BITS
    last = hashes.filter(F.shiftright("h", shift) == prefix).toArrow()["h"].to_numpy()
    return int(np.partition(last, k - 1)[k - 1])


def positioned(df: DataFrame) -> DataFrame:
    """Adds ``_position``: the place 0..n-1 of a row in the order of ``row_id``, whatever the ids are.

    Batches are taken by position, so gaps, large and repeated ids lose no row. One range shuffle.
    """
    return with_row_id(df, "row_id", "_position")


def sample_batch(
    df: DataFrame, b: int, step: int = 0, seed: int = 0, num_rows: int | None = None
) -> DataFrame:
    """A random batch of exactly ``b`` rows (all rows if there are fewer), new for every step.

    The rows with the smallest hashes of (position, seed, step): a cut is found by counting
    and then filters the rows, which neither move nor get sorted. A frame that is not
    :func:`positioned` is numbered first, once for each call.
    """
    n = df.count() if num_rows is None else num_rows
    if b >= n:
        return df
    rows = df if "_position" in df.columns else positioned(df)
    key = F.xxhash64("_position", F.lit(seed), F.lit(step))
    return rows.filter(key <= F.lit(_hash_cut(rows.select(key.alias("h")), b))).select(*df.columns)


def batch_start(b: int, step: int, num_rows: int) -> int:
    """First row of the window of a step; the window moves by ``b`` and returns to 0 at the end."""
    windows = max(1, -(-num_rows // b))
    return (step % windows) * b


def consecutive_batch(df: DataFrame, b: int, step: int = 0, num_rows: int | None = None) -> DataFrame:
    """The window of ``b`` consecutive rows, in the order of ``row_id``, of a step.

    The last window of a cycle may be shorter; every row is in one window of a cycle. A frame that
    is not :func:`positioned` is numbered first, once for each call.
    """
    n = df.count() if num_rows is None else num_rows
    start = batch_start(b, step, n)
    rows = df if "_position" in df.columns else positioned(df)
    inside = (F.col("_position") >= start) & (F.col("_position") < start + b)
    return rows.filter(inside).select(*df.columns)


class _Rule:
    """Update rules of the minibatch trainer; the step is subtracted from the weights."""

    def __init__(self, kind: str, shape, lr: float, momentum: float, decay: float, eps: float):
        self.lr, self.momentum, self.decay, self.eps = lr, momentum, decay, eps
        self.velocity, self.cache = np.zeros(shape), np.zeros(shape)
        self.adam = AdamMoments(shape, lr, 0.9, 0.999, eps)
        self.step = {
            "adam": self.adam.corrected_step,
            "sgd": self._sgd,
            "momentum": self._momentum,
            "rmsprop": self._rmsprop,
        }[kind]

    def _sgd(self, g):
        return self.lr * g

    def _momentum(self, g):
        self.velocity = self.momentum * self.velocity - self.lr * g
        return -self.velocity

    def _rmsprop(self, g):
        self.cache = self.decay * self.cache + (1 - self.decay) * g * g
        return self.lr * g / (np.sqrt(self.cache) + self.eps)


def umlr_minibatch(
    df: DataFrame,
    batch_size: int = 0,
    epochs: int = 1000,
    lr: float = 0.01,
    reg: float = 0.0,
    eta: float = 0.0,
    update: str = "adam",
    batch: str | None = None,
    momentum: float = 0.9,
    decay: float = 0.99,
    eps: float = 1e-8,
    seed: int = 0,
) -> Model:
    """Maximal-uncorrelated multinomial regression on one batch per epoch.

    ``batch_size=0`` takes all rows. ``batch`` is ``"consecutive"`` (windows in the order of
    ``row_id``; the default of ``adam``) or ``"random"`` (the default of the other rules). The rows are
    numbered and range-sorted once, so that a window reads few of the cached batches.
    """
    if update not in ("adam", "sgd", "momentum", "rmsprop"):
        raise ValueError(f"unknown update {update!r}")
    batch = batch or ("consecutive" if update == "adam" else "random")
    rows, classes, _ = indexed(df.drop("block_id"))
    W = np.zeros((num_features(df), len(classes)))
    rule = _Rule(update, W.shape, lr, momentum, decay, eps)
    if batch_size <= 0:
        cached, n, parts = _cached_chunks(rows)
        full = True
    else:
        cached = positioned(rows).persist(_KEEP)
        n, parts = (
            cached.withColumn("_part", F.spark_partition_id()).agg(F.count("*"), F.max("_part") + 1).first()
        )
        if not n:
            raise ValueError("no row to fit")
        full = batch_size >= n
    history = []
    with fixed_plans(df.sparkSession):
        for t in range(epochs):
            if batch_size <= 0:
                partials = cached.select("p", "X", "y").mapInArrow(softmax_partials(W), "s array<double>")
            else:
                picked = cached
                if not full and batch == "consecutive":
                    picked = consecutive_batch(cached, batch_size, t, n)
                elif not full:
                    picked = sample_batch(cached, batch_size, t, seed, n)
                partials = picked.select("label", "features").mapInArrow(softmax_row_partials(W), "s array<double>")
            b, loss, g = _sums(partials, parts, W)
            if not b:
                raise ValueError(f"the batch of step {t} is empty")
            penalty = umlr_penalty(W, reg, eta)
            g = g / b + reg * W + eta * W * uncorrelated_coefficients(W)
            step = rule.step(g)
            W = W - step
            history.append({"round": t, "diff": float(np.abs(step).mean()), "loss": loss / b + penalty})
    cached.unpersist()
    params = dict(batch_size=batch_size, epochs=epochs, lr=lr, reg=reg, eta=eta, update=update, batch=batch)
    return Model(df.sparkSession, W, classes, history_rows=history, params=params)
