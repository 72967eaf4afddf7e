"""The round loop shared by all ADMM trainers, and the weights they end with."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.operators.linalg import block_mean
from blockfit.operators.prepare import label_index
from blockfit.plans.resume import SavedRounds

# sufficient statistics or block states that may be held on the driver, in bytes;
# larger ones stay in tables
STATS_LIMIT = 256 << 20


class Problem(Protocol):
    """One ADMM problem: its rounds run Spark jobs or work on aggregated statistics.

    ``parts`` is the number of partitions of the cached side of its joins, if it has any.
    """

    parts: int | None

    def advance(self) -> dict:
        """Run one round; may return ``diff`` or ``loss`` for the history."""

    def residuals(self) -> tuple[float, float]:
        """Primal and dual residual against the state at the previous call."""

    def cut_lineage(self) -> None:
        """Make the state independent of the rounds before."""

    def weights(self) -> np.ndarray: ...

    def close(self) -> None: ...


def run_admm(
    problem: Problem,
    max_iter: int,
    tol: float,
    check_every: int = 5,
    checkpoint_every: int = 5,
    saved: SavedRounds | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """Rounds until both residuals are at most ``tol``, looked at in rounds 0, ``check_every``, ...

    A ``tol`` below 0 never stops early, and spares the checks. With ``saved``, the rounds go on after the last
    one kept there; a round is kept every ``checkpoint_every`` rounds and at the end.
    """
    history, start, finished = [], 0, False
    try:
        if saved:
            start, history, finished = saved.restore(problem)
        for t in range(start, 0 if finished else max_iter):
            row = {"round": t, **(problem.advance() or {})}
            if checkpoint_every and t and t % checkpoint_every == 0:
                problem.cut_lineage()
            if tol >= 0 and t % check_every == 0:
                row["primal"], row["dual"] = map(float, problem.residuals())
            if len(row) > 1:
                history.append(row)
            stop = "primal" in row and row["primal"] <= tol and row["dual"] <= tol
            if saved and (stop or t == max_iter - 1 or checkpoint_every and t and t % checkpoint_every == 0):
                saved.write(problem, t + 1, history, stop)
            if stop:
                break
        return problem.weights(), history
    finally:
        problem.close()


def current_weights(
    state: DataFrame, kind: str, blocks: Sequence[tuple[int, int]] | None = None
) -> DataFrame:
    """``<feature_idx, value>`` from block states: their mean, or one block after the other."""
    if kind == "mean":
        return block_mean(state, "x").select(F.posexplode("x").alias("feature_idx", "value"))
    starts = F.array(*[F.lit(lo) for lo, _ in blocks])
    entries = state.select("block_id", F.posexplode("x").alias("pos", "value"))
    at = starts[F.col("block_id").cast("int")] + F.col("pos")
    return entries.select(at.alias("feature_idx"), "value")


def indexed(df: DataFrame) -> tuple[DataFrame, list, int]:
    """The frame with class indices as labels, the sorted classes, and the number of rows.

    Rows without a label are left out.
    """
    labelled = df.filter(F.col("label").isNotNull())
    counts = labelled.groupBy("label").count().collect()
    if not counts:
        raise ValueError("no labelled row")
    classes = sorted(r["label"] for r in counts)
    return label_index(labelled, classes), classes, sum(r["count"] for r in counts)


def num_features(df: DataFrame) -> int:
    row = df.filter(F.col("features").isNotNull()).select(F.size("features").alias("p")).first()
    if row is None:
        raise ValueError("no row to fit")
    return row["p"]
