"""A fit that is stopped and goes on equals an unbroken one."""

import os

import numpy as np
import pytest

from blockfit.plans import consensus
from blockfit.plans.consensus import consensus_lasso, consensus_smlr, umlr_consensus

LASSO = dict(num_blocks=3, max_iter=9, tol=-1.0, checkpoint_every=2, block_by="key")
SMLR = dict(num_blocks=2, max_iter=5, tol=-1.0, checkpoint_every=1, block_by="key", local_steps=2)
UMLR = dict(num_blocks=2, epochs=6, checkpoint_every=2, block_by="key")
CASES = {
    "lasso": (consensus_lasso, LASSO, "_LassoHeld", 6),
    "lasso table": (consensus_lasso, {**LASSO, "stats_limit": 0}, "_LassoTable", 6),
    "smlr": (consensus_smlr, SMLR, "_SparseHeld", 3),
    "smlr table": (consensus_smlr, {**SMLR, "stats_limit": 0}, "_SparseTable", 3),
    "smlr passes": (consensus_smlr, {**SMLR, "stats_limit": 0, "max_block_bytes": 64}, "_SparsePasses", 3),
    "umlr": (umlr_consensus, UMLR, "_UncorrelatedHeld", 4),
    "umlr table": (umlr_consensus, {**UMLR, "stats_limit": 0}, "_UncorrelatedTable", 4),
}


@pytest.mark.parametrize("case", CASES)
def test_a_stopped_fit_goes_on_after_its_last_kept_round(frame, tmp_path, monkeypatch, case):
    fit, settings, kind, fails_at = CASES[case]
    rng = np.random.default_rng(7)
    X = rng.normal(size=(80, 3))
    y = X @ [2.0, 0, -1] if "lasso" in case else rng.integers(0, 3, 80)
    df, folder = frame(X, y), str(tmp_path / "rounds")
    whole = fit(df, **settings)
    problem, calls = getattr(consensus, kind), []
    advance = problem.advance

    def failing(self):
        calls.append(1)
        if len(calls) == fails_at:
            raise RuntimeError("stopped")
        return advance(self)

    monkeypatch.setattr(problem, "advance", failing)
    with pytest.raises(RuntimeError, match="stopped"):
        fit(df, **settings, resume=folder)
    assert len(os.listdir(folder)) == 1
    os.makedirs(f"{folder}/round-999/state")  # not complete
    before = len(calls)
    got = fit(df, **settings, resume=folder)
    rounds = settings.get("max_iter", settings.get("epochs"))
    assert 0 < len(calls) - before < rounds
    np.testing.assert_allclose(got.W, whole.W, atol=1e-12)
    assert len(got.history.collect()) == len(whole.history.collect())
    # all rounds are done: nothing runs again
    before = len(calls)
    np.testing.assert_array_equal(fit(df, **settings, resume=folder).W, got.W)
    assert len(calls) == before


def test_rounds_of_another_fit_are_an_error(frame, tmp_path):
    rng = np.random.default_rng(8)
    df = frame(rng.normal(size=(40, 2)), rng.normal(size=40))
    folder = str(tmp_path / "rounds")
    consensus_lasso(df, **LASSO, resume=folder)
    with pytest.raises(ValueError, match="other parameters"):
        consensus_lasso(df, **{**LASSO, "rho": 9.0}, resume=folder)
    # more rounds go on, and a fit that reached its tolerance ends there
    longer = consensus_lasso(df, **{**LASSO, "max_iter": 14}, resume=folder)
    np.testing.assert_allclose(longer.W, consensus_lasso(df, **{**LASSO, "max_iter": 14}).W, atol=1e-12)
