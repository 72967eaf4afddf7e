"""Trainers against plain NumPy rounds, optimality conditions and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockfit.operators.blocks import feature_blocks
from blockfit.model import Model
from blockfit.operators.linalg import gram, ls_gradient, margins, softmax_gradient
from blockfit.operators.score import predict_class, predict_linear
from blockfit.plans import consensus, descent, sharing
from blockfit.plans.consensus import consensus_lasso, consensus_smlr, umlr_consensus
from blockfit.plans.descent import least_squares_gd, umlr_adam, umlr_minibatch
from blockfit.plans.sharing import sharing_lasso, sharing_smlr, umlr_sharing


def S(a, k):
    return np.maximum(a - k, 0) - np.maximum(-a - k, 0)


def softmax(M):
    e = np.exp(M - M.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def lasso_small():
    rng = np.random.default_rng(42)
    X = rng.normal(size=(200, 6))
    return X, X @ np.array([3.0, 0, -2, 0, 0, 1]) + 0.1 * rng.normal(size=200)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(3, 4)) * 2
    y = np.repeat([0, 1, 2], 50)
    return centres[y] + rng.normal(size=(150, 4)), y


def assert_lasso_optimal(X, y, w, lam, tol):
    g = X.T @ (X @ w - y)
    zero = np.abs(w) < 1e-9
    assert (np.abs(g[zero]) <= lam + tol).all()
    np.testing.assert_allclose(g[~zero], -lam * np.sign(w[~zero]), atol=tol)


def test_lassos_reach_the_optimum(frame, lasso_small):
    X, y = lasso_small
    df = frame(X, y)
    a = consensus_lasso(df, lam=20.0, rho=20.0, num_blocks=3, max_iter=400, tol=-1).W[:, 0]
    b = sharing_lasso(df, lam=20.0, rho=1.0, num_blocks=3, max_iter=2000, tol=-1).W[:, 0]
    assert_lasso_optimal(X, y, a, 20.0, 1e-5)
    assert_lasso_optimal(X, y, b, 20.0, 1e-3)
    assert (a[[1, 3, 4]] == 0).all()
    np.testing.assert_allclose(a, b, atol=1e-4)


def test_lasso_stops_at_the_first_check_within_tolerance(frame, lasso_small):
    X, y = lasso_small
    model = consensus_lasso(frame(X, y), lam=1.0, rho=20.0, num_blocks=2, max_iter=300, tol=0.01)
    rows = model.history.collect()
    assert [r["round"] for r in rows] == list(range(0, 5 * len(rows), 5))
    assert max(rows[-1]["primal"], rows[-1]["dual"]) <= 0.01
    assert all(max(r["primal"], r["dual"]) > 0.01 for r in rows[:-1])


def test_sharing_lasso_closed_form_and_singular(frame):
    rng = np.random.default_rng(5)
    Q, _ = np.linalg.qr(rng.normal(size=(200, 4)))
    y = Q @ np.array([2.0, -1, 0.1, 0]) + 0.01 * rng.normal(size=200)
    args = dict(lam=0.2, rho=0.5, num_blocks=2, max_iter=30, tol=-1)
    exact = sharing_lasso(frame(Q, y), **args).W
    closed = sharing_lasso(frame(Q, y), x_step="closed_form", **args).W
    np.testing.assert_allclose(exact, closed, atol=1e-9)
    X = np.column_stack([Q[:, 0], Q[:, 0], Q[:, 1], Q[:, 2]])
    w = sharing_lasso(frame(X, y), lam=0.2, rho=0.5, num_blocks=2, max_iter=300, tol=-1).W[:, 0]
    assert_lasso_optimal(X, y, w, 0.2, 1e-3)


def same_by_table(fit, *args, **kwargs):
    """The state on the driver and in tables must give the same weights."""
    held = fit(*args, **kwargs)
    table = fit(*args, stats_limit=0, **kwargs)
    np.testing.assert_allclose(held.W, table.W, atol=1e-9)
    return held, table


def test_consensus_lasso_by_table(frame, lasso_small):
    X, y = lasso_small
    held, table = same_by_table(
        consensus_lasso, frame(X, y), lam=1.0, rho=20.0, num_blocks=5, max_iter=8, tol=0.0, checkpoint_every=3
    )
    for a, b in zip(held.history_rows, table.history_rows):
        assert a["primal"] == pytest.approx(b["primal"]) and a["dual"] == pytest.approx(b["dual"])


def test_sharing_lasso_by_table(frame, lasso_small):
    X, y = lasso_small
    held, table = same_by_table(
        sharing_lasso, frame(X, y), lam=1.0, rho=0.5, num_blocks=3, max_iter=7, tol=0.0, checkpoint_every=3
    )
    checked = [r for r in table.history_rows if "primal" in r]
    assert [r["round"] for r in checked] == [r["round"] for r in held.history_rows] == [0, 5]
    for a, b in zip(held.history_rows, checked):
        assert a["primal"] == pytest.approx(b["primal"], abs=1e-6) and a["dual"] == pytest.approx(b["dual"])


def test_least_squares_reaches_the_normal_equations(frame, lasso_small):
    X, y = lasso_small
    held, _ = same_by_table(least_squares_gd, frame(X, y), lr=2e-3, epochs=60)
    np.testing.assert_allclose(held.W[:, 0], np.linalg.lstsq(X, y, rcond=None)[0], atol=1e-3)
    scored = predict_linear(frame(X, y), held).toPandas().sort_values("row_id")
    np.testing.assert_allclose(scored.prediction, X @ held.W[:, 0], atol=1e-12)


def adam(x, gradient, alpha, steps):
    m = v = np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - alpha * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    return x


def smlr_rounds(A, Y, blocks, lam, rho, alpha, steps, rounds, middle):
    N = len(blocks)
    x = [np.zeros((A.shape[1], Y.shape[1]))] * N
    u, z = list(x), x[0]
    for _ in range(rounds):
        x = [
            adam(x[i], lambda w, i=i, r=r: A[r].T @ (softmax(A[r] @ w) - Y[r]) + rho * (w - z + u[i]), alpha, steps)
            for i, r in enumerate(blocks)
        ]
        s = np.array(x) + np.array(u)
        z = S(np.sort(s, axis=0)[N // 2] if middle == "median" else s.mean(axis=0), lam / (N * rho))
        u = [u[i] + x[i] - z for i in range(N)]
    return z


@pytest.mark.parametrize("middle", ["median", "mean"])
def test_consensus_smlr_rounds(frame, blobs, middle):
    X, y = blobs
    args = dict(
        lam=0.1, rho=1.0, alpha=0.02, num_blocks=4, max_iter=3, tol=-1, local_steps=12,
        consensus=middle, block_by="key", checkpoint_every=2,
    )
    held, _ = same_by_table(consensus_smlr, frame(X, y + 1), **args)
    A, Y = np.column_stack([X, np.ones(150)]), np.eye(3)[y]
    blocks = [np.arange(150) % 4 == i for i in range(4)]
    want = smlr_rounds(A, Y, blocks, 0.1, 1.0, 0.02, 12, 3, middle)
    np.testing.assert_allclose(held.W, want, atol=1e-9)
    split = consensus_smlr(frame(X, y + 1), max_block_bytes=1, **args)
    np.testing.assert_allclose(split.W, want, atol=1e-9)
    passes = consensus_smlr(frame(X, y + 1), max_block_bytes=1, stats_limit=0, **args)
    np.testing.assert_allclose(passes.W, want, atol=1e-9)
    assert held.classes == [1, 2, 3]
    predicted = predict_class(frame(X, y + 1), held).toPandas()
    assert (predicted.label == predicted.prediction).mean() > 0.6


def test_consensus_smlr_by_passes_with_a_hot_block(frame, blobs, monkeypatch):
    """A block with most of the rows is spread over many chunks; its state is one row and no file stays."""
    X, y = blobs
    blocks = [10 * int(k // 5 % 3) if k % 5 == 0 else 0 for k in range(len(X))]
    df = frame(X, y, block_id=blocks)
    pack = consensus.pack_chunks
    monkeypatch.setattr(consensus, "pack_chunks", lambda rows, parts, size, **k: pack(rows, parts, 512, **k))
    args = dict(lam=0.1, rho=1.0, alpha=0.02, num_blocks=3, max_iter=2, tol=-1, local_steps=4)
    saved = []
    store = consensus._SparsePasses._store
    monkeypatch.setattr(consensus._SparsePasses, "_store", lambda self, new: (store(self, new), saved.append(self))[0])
    got = consensus_smlr(df, max_block_bytes=1, stats_limit=0, **args)
    assert len(saved) == 1 + 2 * 4 and saved[0].salts.count() >= 1
    A, Y = np.column_stack([X, np.ones(len(X))]), np.eye(3)[y]
    parts = [np.array(blocks) == b for b in (0, 10, 20)]
    np.testing.assert_allclose(got.W, smlr_rounds(A, Y, parts, 0.1, 1.0, 0.02, 4, 2, "median"), atol=1e-9)


def test_median_consensus_withstands_a_bad_block(frame):
    rng = np.random.default_rng(42)
    X = rng.normal(size=(400, 8)) * 2
    y = X[:, :3].argmax(axis=1)
    train, test = np.arange(400) < 320, np.arange(400) >= 320
    block = np.arange(320) % 5
    bad = np.where(block == 0, (y[train] + 1) % 3, y[train])

    def accuracy(labels, middle):
        df = frame(X[train], labels, block_id=block)
        model = consensus_smlr(df, lam=0.01, rho=1.0, alpha=0.01, num_blocks=5, max_iter=12, tol=-1, consensus=middle)
        margins = np.column_stack([X[test], np.ones(80)]) @ model.W
        return (margins.argmax(axis=1) == y[test]).mean()

    loss = {m: accuracy(y[train], m) - accuracy(bad, m) for m in ("median", "mean")}
    assert loss["median"] <= loss["mean"]


def test_umlr_consensus_rounds_with_a_hot_block(frame, blobs):
    X, y = blobs
    rng = np.random.default_rng(6)
    block = np.where(rng.random(150) < 0.6, 0, rng.integers(1, 4, 150))
    held, _ = same_by_table(
        umlr_consensus, frame(X, y, block_id=block), epsilon=0.1, rho=0.1, eta=0.01, num_blocks=4, epochs=6,
        checkpoint_every=2,
    )
    Y, N = np.eye(3)[y], 4
    x = u = np.ones((N, 4, 3))
    z = np.ones((4, 3))
    for _ in range(6):
        g = np.array([X[block == i].T @ (softmax(X[block == i] @ x[i]) - Y[block == i]) for i in range(N)])
        g = N / 150 * g + 0.1 * (x - z + u)
        u, x = u + x - z, x - 0.1 * g
        norm = (z**2).sum(axis=0)
        z = 0.1 * N * (x.mean(axis=0) + u.mean(axis=0)) / (0.01 * (norm.sum() - norm) + N * 0.1)
    np.testing.assert_allclose(held.W, z, atol=1e-9)


def test_empty_block_is_reported(frame, blobs):
    X, y = blobs
    df = frame(X, y, block_id=np.zeros(150, dtype=int))
    for fit in (consensus_lasso, consensus_smlr, umlr_consensus):
        with pytest.raises(ValueError, match="blocks"):
            fit(df, num_blocks=2)


def test_sharing_smlr_rounds(frame, blobs):
    X, y = blobs
    lam, rho, alpha, N = 0.05, 0.5, 0.02, 2
    held, _ = same_by_table(
        sharing_smlr, frame(X, y), lam=lam, rho=rho, alpha=alpha, num_blocks=N, max_iter=4, tol=-1,
        inner_iter=20, z_steps=15, checkpoint_every=2,
    )
    Y = np.eye(3)[y]
    blocks = feature_blocks(4, N, "ceil")
    x = np.zeros((4, 3))
    z = u = abar = np.zeros((150, 3))
    for _ in range(4):
        new = np.zeros_like(x)
        for lo, hi in blocks:
            A = X[:, lo:hi]
            t = A @ x[lo:hi] + z - abar - u
            zi = ui = np.zeros((hi - lo, 3))
            for _ in range(20):
                v = np.linalg.solve(rho * A.T @ A + np.eye(hi - lo), rho * A.T @ t + zi - ui)
                zi = S(v + ui, lam)
                ui = ui + v - zi
            new[lo:hi] = zi
        x = new
        abar = X @ x / N
        z = adam(z, lambda w: N * (softmax(N * w) - Y + rho * (w - abar - u)), alpha, 15)
        u = u + abar - z
    np.testing.assert_allclose(held.W, x, atol=1e-8)


def test_umlr_sharing_rounds(frame, blobs, monkeypatch):
    monkeypatch.setattr(sharing, "MAX_CHUNK_BYTES", 1000)
    X, y = blobs
    rho, eta, eps, N = 0.1, 0.01, 0.05, 3
    held, _ = same_by_table(
        umlr_sharing, frame(X, y), num_blocks=N, epsilon=eps, rho=rho, eta=eta, epochs=6, checkpoint_every=2
    )
    Y, x = np.eye(3)[y], np.ones((4, 3))
    z = u = abar = np.ones((150, 3))
    for _ in range(6):
        new = np.zeros_like(x)
        for lo, hi in feature_blocks(4, N, "balanced"):
            A = X[:, lo:hi]
            norm = (x[lo:hi] ** 2).sum(axis=0)
            for k in range(3):
                M = eta * (norm.sum() - norm[k]) * np.eye(hi - lo) + rho * A.T @ A
                right = A.T @ (A @ x[lo:hi, k] + z[:, k] - abar[:, k] - u[:, k])
                new[lo:hi, k] = rho * np.linalg.pinv(M) @ right
        x = new
        abar = X @ x / N
        z = z - eps * N * (softmax(N * z) - Y + rho * (z - abar - u))
        u = u + abar - z
    np.testing.assert_allclose(held.W, x, atol=1e-8)


def umlr_gradient(X, Y, W, reg, eta):
    norm = (W**2).sum(axis=0)
    return X.T @ (softmax(X @ W) - Y), reg * W + eta * W * (norm.sum() - norm)


def test_umlr_adam_and_layout(frame, blobs):
    X, y = blobs
    Y, W = np.eye(3)[y], np.zeros((4, 3))
    m = v = np.zeros_like(W)
    for t in range(1, 8):
        g, penalty = umlr_gradient(X, Y, W, 0, 1e-3)
        g = g + 150 * penalty
        m, v = 0.9 * m + 0.1 * g, 0.9999 * v + 0.0001 * g * g
        W = W - 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.9999**t)) + 1e-8)
    args = dict(lr=0.05, eta=1e-3, epochs=7)
    order = np.random.default_rng(7).permutation(150)
    np.testing.assert_allclose(umlr_adam(frame(X, y, parts=1), **args).W, W, atol=1e-9)
    shuffled = frame(X[order], y[order], ids=order, parts=6)
    np.testing.assert_allclose(umlr_adam(shuffled, **args).W, W, atol=1e-9)


def test_minibatch_gradient_is_the_derivative_of_the_loss(frame, blobs):
    X, y = blobs
    start = np.zeros((4, 3))
    step = umlr_minibatch(frame(X, y), epochs=1, lr=1.0, reg=0.1, eta=0.2, update="sgd")
    g, penalty = umlr_gradient(X, np.eye(3)[y], start, 0.1, 0.2)
    np.testing.assert_allclose(step.W, -(g / 150 + penalty), atol=1e-12)

    from blockfit.operators.linalg import softmax_sums, umlr_loss

    rng = np.random.default_rng(8)
    W, D = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    df = frame(X, y).withColumn("label", F.col("label").cast("double"))
    up, down = (umlr_loss(df, W + s * 1e-5 * D, 0.1, 0.2).first()[0] for s in (1, -1))
    g, penalty = umlr_gradient(X, np.eye(3)[y], W, 0.1, 0.2)
    assert (up - down) / 2e-5 == pytest.approx(((g / 150 + penalty) * D).sum(), rel=1e-6)
    np.testing.assert_allclose(np.array(softmax_sums(df, W).first()["gradient"]).reshape(4, 3), g, atol=1e-9)


def test_minibatches_consecutive_and_random(frame, blobs):
    X, y = blobs
    args = dict(batch_size=64, epochs=4, lr=0.1, eta=0.01)
    W, m, v = np.zeros((4, 3)), 0, 0
    for t in range(4):
        rows = slice(*(t % 3 * 64 + np.array([0, 64])))
        A, Y = X[rows], np.eye(3)[y[rows]]
        g, penalty = umlr_gradient(A, Y, W, 0, 0.01)
        g = g / len(A) + penalty
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        W = W - 0.1 * m / (1 - 0.9 ** (t + 1)) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    np.testing.assert_allclose(umlr_minibatch(frame(X, y), **args).W, W, atol=1e-9)
    for rule in ("sgd", "momentum", "rmsprop"):
        model = umlr_minibatch(frame(X, y), update=rule, **args)
        assert np.isfinite(model.W).all() and model.history_rows[-1]["loss"] < model.history_rows[0]["loss"]


def test_minibatches_meet_every_row(frame, blobs):
    X, y = blobs
    args = dict(batch_size=-(-len(X) // 3), epochs=3, lr=0.1)
    far = umlr_minibatch(frame(X, y, ids=1000 + 7 * np.arange(len(X))), **args).W
    np.testing.assert_allclose(far, umlr_minibatch(frame(X, y), **args).W, atol=1e-12)
    labels = [None if k % 10 == 0 else int(v) for k, v in enumerate(y)]
    changed = [None if v is None else (v + 1) % 3 if k >= len(y) - 40 else v for k, v in enumerate(labels)]
    first, second = (umlr_minibatch(frame(X, v), **args).W for v in (labels, changed))
    assert np.isfinite(first).all() and np.abs(first - second).max() > 1e-6


def test_one_class_and_ties(spark, frame):
    model = umlr_adam(frame(np.ones((5, 2)), ["a"] * 5), epochs=2)
    assert model.classes == ["a"] and (model.W == 0).all()
    tied = umlr_adam(frame(np.ones((4, 2)), ["b", "a"] * 2), epochs=1)
    assert {r["prediction"] for r in predict_class(frame(np.ones((3, 2)), ["a"] * 3), tied).collect()} == {"a"}


def test_wide_models_score_by_kernel_like_by_column(frame):
    rng = np.random.default_rng(9)
    X, W = rng.normal(size=(50, 40)), rng.normal(size=(41, 3))
    from blockfit.model import Model
    from blockfit.operators.linalg import margins

    df = frame(X, np.zeros(50))
    model = Model(df.sparkSession, W, ["x", "y", "z"], bias=True)
    got = predict_class(df, model).toPandas().sort_values("row_id").prediction.tolist()
    M = np.column_stack([X, np.ones(50)]) @ W
    assert got == [["x", "y", "z"][k] for k in M.argmax(axis=1)]
    m = margins(df, W[:-1]).toPandas().sort_values("row_id").margins
    np.testing.assert_allclose(np.stack(m), X @ W[:-1], atol=1e-12)


def test_scoring_works_on_a_stream(spark, frame, tmp_path):
    from blockfit.model import Model

    X = np.random.default_rng(10).normal(size=(20, 2))
    frame(X, np.zeros(20)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, label double, features array<double>").parquet(str(tmp_path / "in"))
    model = Model(spark, np.eye(2), [10, 20])
    run = (
        predict_class(stream, model).writeStream.format("memory").queryName("scored")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run.awaitTermination(60)
    got = {r["row_id"]: r["prediction"] for r in spark.table("scored").collect()}
    assert got == {i: 10 if X[i, 0] >= X[i, 1] else 20 for i in range(20)}


def test_wide_statistics_are_added_by_spark(frame, lasso_small, monkeypatch):
    from blockfit.operators import linalg

    monkeypatch.setattr(linalg, "PARTIALS_LIMIT", 0)
    monkeypatch.setattr(consensus, "PARTIALS_LIMIT", 0)
    X, y = lasso_small
    df = frame(X, (y > 0).astype(int))
    a = umlr_adam(df, epochs=3).W
    b = umlr_consensus(df, num_blocks=2, epochs=3, block_by="key").W
    monkeypatch.undo()
    np.testing.assert_allclose(a, umlr_adam(df, epochs=3).W, atol=1e-12)
    np.testing.assert_allclose(b, umlr_consensus(df, num_blocks=2, epochs=3, block_by="key").W, atol=1e-12)
    assert descent.STATS_LIMIT > 0


def _outcome(fn):
    try:
        return fn()
    except Exception as error:  # noqa: BLE001
        return "null" if "null among" in str(error) else "ragged" if "differ in their number" in str(error) else error


@pytest.mark.parametrize("p", [8, 9])
def test_one_null_rule_for_statistics(spark, frame, p):
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(40, p)), rng.normal(size=40)
    df = frame(X, y)
    holed = df.withColumn("label", F.when(F.col("row_id") != 3, F.col("label")))
    keep = np.arange(40) != 3
    row = gram(holed, p).first()
    assert row["n"] == 39
    np.testing.assert_allclose(row["gram"], (X[keep].T @ X[keep]).ravel())
    np.testing.assert_allclose(row["cross"], X[keep].T @ y[keep])
    model = least_squares_gd(holed, lr=1e-3, epochs=3)
    np.testing.assert_allclose(model.W, least_squares_gd(frame(X[keep], y[keep]), lr=1e-3, epochs=3).W)
    w = np.ones(p)
    got = [r["value"] for r in ls_gradient(holed, w).orderBy("feature_idx").collect()]
    np.testing.assert_allclose(got, X[keep].T @ (X[keep] @ w - y[keep]))
    none = df.withColumn("features", F.when(F.col("row_id") != 3, F.col("features")))
    hole = df.withColumn("features", F.transform("features", lambda v: F.when(F.col("row_id") != 3, v)))
    short = df.withColumn("features", F.when(F.col("row_id") != 3, F.col("features")).otherwise(F.slice("features", 1, 2)))
    for bad, said in ((none, "null"), (hole, "null"), (short, "ragged")):
        assert _outcome(lambda: gram(bad, p).collect()) == said  # noqa: B023
        assert _outcome(lambda: ls_gradient(bad, w).collect()) == said  # noqa: B023


@pytest.mark.parametrize("p", [64, 65])
def test_one_null_rule_for_scoring(spark, frame, p):
    X = np.arange(4.0 * p).reshape(4, p)
    df = frame(X, np.zeros(4))
    holed = df.withColumn(
        "features",
        F.when(F.col("row_id") == 1, F.lit(None).cast("array<double>")).otherwise(
            F.transform("features", lambda v: F.when(F.col("row_id") != 2, v))
        ),
    )
    got = {r["row_id"]: r["prediction"] for r in predict_linear(holed, Model(spark, np.ones((p, 1)))).collect()}
    assert got[1] is None and got[2] is None and got[0] == X[0].sum() and got[3] == X[3].sum()
    W = np.stack([np.ones(p), -np.ones(p)], axis=1)
    got = {r["row_id"]: r["prediction"] for r in predict_class(holed, Model(spark, W, ["a", "b"])).collect()}
    assert got[1] is None and got[2] is None and got[3] == "a"
    got = {r["row_id"]: r["margins"] for r in margins(holed, W).collect()}
    assert got[1] is None and got[2] is None and got[3] == [X[3].sum(), -X[3].sum()]
    short = df.withColumn("features", F.when(F.col("row_id") != 1, F.col("features")).otherwise(F.slice("features", 1, 9)))
    assert _outcome(lambda: predict_linear(short, Model(spark, np.ones((p, 1)))).collect()) == "ragged"
    assert _outcome(lambda: predict_class(short, Model(spark, W, ["a", "b"])).collect()) == "ragged"


def test_wide_sums_are_cut_into_segments(spark, frame, monkeypatch):
    rng = np.random.default_rng(5)
    X, y = rng.normal(size=(60, 12)), rng.normal(size=60)
    df = frame(X, y, parts=5).withColumn("block_id", F.pmod("row_id", F.lit(2)))
    plain = {r["block_id"]: r for r in gram(df, 12).collect()}
    monkeypatch.setattr("blockfit.operators.trees.SEGMENT", 10)
    monkeypatch.setattr("blockfit.operators.trees.READ_LIMIT", 160)
    table = gram(df, 12)
    cut = {r["block_id"]: r for r in table.collect()}
    for b in (0, 1):
        assert cut[b]["n"] == plain[b]["n"] == 30
        for c in ("gram", "cross"):
            np.testing.assert_allclose(cut[b][c], plain[b][c], rtol=1e-12)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "segment" in plan and "shufflepartitionidpassthrough" in plan.lower()
    W = rng.normal(size=(12, 3))
    rows = df.withColumn("label", F.pmod("row_id", F.lit(3)).cast("double"))
    first = softmax_gradient(rows, W).toPandas()
    monkeypatch.setattr("blockfit.operators.trees.SEGMENT", 1 << 16)
    second = softmax_gradient(rows, W).toPandas()
    keys = ["feature_idx", "class_idx"]
    np.testing.assert_allclose(first.sort_values(keys).value, second.sort_values(keys).value)


def test_consensus_table_moves_only_the_state(spark, frame, blobs, monkeypatch):
    """The placed chunks have no exchange and no sort above them, a block with most rows included."""
    X, y = blobs
    blocks = np.where(np.arange(len(X)) % 5 == 0, np.arange(len(X)) // 5 % 3, 0)
    df = frame(X, y, block_id=[int(b) for b in blocks])
    plans = []
    advance = consensus._UncorrelatedTable.advance

    def watched(self):
        plans.append((self.joined()._jdf.queryExecution().executedPlan().toString(), self.salts.count()))
        return advance(self)

    monkeypatch.setattr(consensus._UncorrelatedTable, "advance", watched)
    pack = consensus.pack_chunks
    monkeypatch.setattr(consensus, "pack_chunks", lambda rows, parts, **k: pack(rows, parts, max_chunk_bytes=512, **k))
    table = umlr_consensus(df, num_blocks=3, epochs=4, stats_limit=0)
    held = umlr_consensus(df, num_blocks=3, epochs=4)
    np.testing.assert_allclose(table.W, held.W, atol=1e-9)
    plan, hot = plans[0]
    assert hot >= 1 and "ShuffledHashJoin" in plan
    chunk_side = plan[plan.index("ShuffledHashJoin") :].split("InMemoryTableScan")[0]
    assert "Exchange" not in chunk_side and "Sort" not in chunk_side
