"""Sparse coding against a direct implementation of its rounds, one test row at a time."""

import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockfit.operators.evaluate import accuracy, attach_truth
from blockfit.plans import coding
from blockfit.plans.coding import classify_by_residual, huber_sparse_code, pixel_weights


def S(a, k):
    return np.sign(a) * np.maximum(np.abs(a) - k, 0)


def weights(r, t, c):
    cut = np.sort(r)[int(len(r) * t)]
    if cut == 0:
        return (r <= cut).astype(float)
    return 1 / (1 + np.exp(np.clip(c / cut * (r - cut), -700, 700)))


def code_one(b, D, ridge, outer, inner, c=1.0):
    """``D``: training rows x pixels."""
    A, theta = D.T, None
    r = (b - A.mean(axis=1)) ** 2
    for _ in range(outer):
        w = np.sqrt(weights(r, 0.7, c))
        WA, Wb = w[:, None] * A, w * b
        Z, Uz = np.ones(len(b)), np.ones(len(b))
        V, Uv = np.ones(A.shape[1]), np.ones(A.shape[1])
        M = WA.T @ WA + (np.eye(A.shape[1]) if ridge == "identity" else 1.0)
        for _ in range(inner):
            right = WA.T @ (Z - Uz + Wb) + V - Uv
            theta = np.linalg.solve(M, right) if ridge == "identity" else np.linalg.pinv(M, hermitian=True) @ right
            v = WA @ theta - Wb + Uz
            Z = v / 2 + S(v / 2, 10 * w)
            V = S(theta + Uv, 1.0)
            Uz = Uz + WA @ theta - Z - Wb
            Uv = Uv + theta - V
        r = (b - A @ theta) ** 2
    return w * np.abs(b - A @ theta)


@pytest.fixture(scope="module")
def faces():
    rng = np.random.default_rng(42)
    base = rng.uniform(0, 255, size=(4, 24))
    y = np.concatenate([np.repeat([0, 1, 2], 8), np.repeat(3, 60)])
    train = base[y] * rng.uniform(0.6, 1.2, (len(y), 1)) + rng.normal(0, 8, (len(y), 24))
    truth = np.arange(20) % 4
    test = base[truth] * rng.uniform(0.6, 1.2, (20, 1)) + rng.normal(0, 8, (20, 24))
    noise = rng.random(test.shape) < 0.3
    return train, y, np.where(noise, rng.uniform(0, 255, test.shape), test), truth


# with c = 1 the weights of bad pixels vanish, and the scalar form with more rows than
# pixels then has no stable solution, neither here nor there
@pytest.mark.parametrize(("ridge", "c"), [("identity", 1.0), ("scalar", 0.02)])
@pytest.mark.parametrize("limit", [1 << 30, 24 * 8 * 10, 0], ids=["whole", "mixed", "tiled"])
def test_codes(frame, faces, ridge, c, limit):
    train, y, test, _ = faces
    codes = huber_sparse_code(
        frame(test, np.zeros(20)).drop("label"), frame(train, [f"p{k}" for k in y]), ridge=ridge, inner=3, c=c,
        max_dictionary_bytes=limit, test_chunk_bytes=1000,
    ).toPandas()
    assert len(codes) == 80 and codes.groupby("test_id").class_label.nunique().eq(4).all()
    for row in codes.itertuples():
        want = code_one(test[row.test_id], train[y == row.class_idx], ridge, 2, 3, c)
        np.testing.assert_allclose(row.residual, want, rtol=1e-5, atol=2e-3)
        assert row.mae == pytest.approx(want[:-1].sum() / 24, rel=1e-5, abs=1e-3)


@pytest.mark.parametrize("cell_bytes", [1 << 30, 2000, 400])
def test_grid_of_any_cell_size_gives_the_codes(frame, faces, cell_bytes, monkeypatch):
    train, y, test, _ = faces
    y = np.where(np.arange(len(y)) % 3 == 0, y, 0)  # one class has most of the dictionary
    args = (frame(test, np.zeros(20)).drop("label"), frame(train, y))
    pack = coding.pack_chunks
    monkeypatch.setattr(coding, "pack_chunks", lambda rows, **k: pack(rows, **{"max_chunk_bytes": 600, **k}))
    dealt = []
    grid = coding._grid

    def watched(pairs, parts, columns, rows):
        tests, dictionary = grid(pairs, parts, columns, rows)
        counts = {r["class_idx"]: r["count"] for r in pairs.groupBy("class_idx").count().collect()}
        dealt.append((counts, parts.count(), columns, rows, tests.count(), dictionary.count()))
        return tests, dictionary

    monkeypatch.setattr(coding, "_grid", watched)
    a = huber_sparse_code(*args).toPandas().sort_values(["test_id", "class_idx"])
    b = huber_sparse_code(*args, max_dictionary_bytes=0, test_chunk_bytes=500, cell_bytes=cell_bytes)
    b = b.toPandas().sort_values(["test_id", "class_idx"])
    np.testing.assert_allclose(a.mae, b.mae, rtol=1e-5, atol=1e-3)
    counts, parts, columns, rows, tests, dictionary = dealt[0]
    # what moves: each pair once per column of its class, each dictionary chunk once per row
    assert tests == sum(columns[k] * n for k, n in counts.items())
    assert dictionary == rows * parts
    cells = sum(columns.values()) * rows
    assert cells == len(columns) if cell_bytes == 1 << 30 else cells > 2 * len(columns) and columns[0] > columns[1]


def test_dictionary_beyond_the_broadcast_limit(frame, faces):
    train, y, test, _ = faces
    args = (frame(test, np.zeros(20)).drop("label"), frame(train, y))
    a = huber_sparse_code(*args).toPandas().sort_values(["test_id", "class_idx"])
    b = huber_sparse_code(*args, broadcast_limit=0, test_chunk_bytes=500).toPandas()
    np.testing.assert_allclose(a.mae, b.sort_values(["test_id", "class_idx"]).mae)


def test_recognition_with_corrupt_pixels(frame):
    rng = np.random.default_rng(42)
    base, y, truth = rng.uniform(0, 255, size=(10, 96)), np.repeat(np.arange(10), 8), np.arange(30) % 10

    def shots(labels):
        return base[labels] * rng.uniform(0.6, 1.2, (len(labels), 1)) + rng.normal(0, 0.03 * 255, (len(labels), 96))

    train, test = shots(y), shots(truth)
    test = np.where(rng.random(test.shape) < 0.5, rng.uniform(0, 255, test.shape), test)
    for ridge in ("identity", "scalar"):
        codes = huber_sparse_code(frame(test, truth).drop("label"), frame(train, y), ridge=ridge)
        pred = classify_by_residual(codes).withColumnRenamed("test_id", "row_id")
        scored = attach_truth(pred, frame(test, truth).select("row_id", "label"))
        assert accuracy(scored).first()["accuracy"] >= 0.95


def test_weights_when_the_cut_is_zero():
    r = np.array([[0.0, 0.0, 0.0, 4.0], [0.0, 1.0, 2.0, 3.0]])
    w = pixel_weights(r, 0.5, 1.0)
    assert w[0].tolist() == [1, 1, 1, 0]
    np.testing.assert_allclose(w[1], 1 / (1 + np.exp((r[1] - 2) / 2)))


@pytest.mark.parametrize(("gamma", "inner"), [(1.0, 1), (1.0, 3), (0.0, 2)])
@pytest.mark.parametrize("p", [2, 7])
def test_sums_of_the_code_over_boxes_and_blocks(gamma, inner, p, monkeypatch):
    rng = np.random.default_rng(42)
    rows = np.concatenate([rng.normal(size=(3000, p)), np.tile(rng.normal(size=(1, p)), (2000, 1))])
    steps = [(rng.normal(size=(400, p)) * 10.0 ** rng.integers(-6, 1, (400, 1)), rng.normal(size=400)) for _ in range(inner)]
    steps[0][0][3, 1] = np.nan
    d = coding.code_parts(rows, steps, gamma, 0.9)
    want = np.column_stack([d @ rows, d.sum(axis=1)])
    got = coding.code_sums(coding.row_box(rows), steps, gamma, 0.9)
    assert np.isnan(got[3]).all()
    np.testing.assert_allclose(np.delete(got, 3, 0), np.delete(want, 3, 0), rtol=1e-9, atol=1e-6)


def test_no_block_holds_all_tests_and_rows(monkeypatch):
    rng = np.random.default_rng(42)
    A, B = rng.normal(size=(3000, 6)), rng.normal(size=(2500, 6))
    held = []
    parts = coding.code_parts

    def watched(rows, steps, *args):
        held.append(len(rows) * len(steps[0][0]))
        return parts(rows, steps, *args)

    monkeypatch.setattr(coding, "code_parts", watched)
    got = coding.code_tests(B, A, coding.CodingParams())
    assert 0 < max(held) <= 1 << 18
    for i in range(0, 2500, 500):
        np.testing.assert_allclose(got[i], code_one(B[i], A, "identity", 2, 2), rtol=1e-6, atol=1e-8)


def test_boxes_spare_most_of_the_rows(monkeypatch):
    rng = np.random.default_rng(42)
    A, B = rng.uniform(size=(20000, 2)) * [900, 1], rng.uniform(size=(2000, 2)) * [900, 1]
    held = []
    parts = coding.code_parts
    monkeypatch.setattr(coding, "code_parts", lambda rows, steps, *a: held.append(len(rows) * len(steps[0][0])) or parts(rows, steps, *a))
    coding.code_tests(B, A, coding.CodingParams())
    assert sum(held) < 0.25 * 2 * len(A) * len(B)


def test_ridge_step_keeps_the_digits_of_a_small_code():
    G, root, g = np.array([[2e11, 3e8], [3e8, 1.2e6]]), np.array([[0.9, 0.7]]), np.array([[600.0, 0.5]])
    f, _, _ = coding._PixelSpaceSolver(G, np.ones(2), 10.0, root, coding.CodingParams()).solve(g, np.zeros((1, 2)), np.zeros(1))
    (a, b), (_, c) = [[Fraction(float(root[0, i] * root[0, j])) * Fraction(G[i, j]) + (i == j) for j in (0, 1)] for i in (0, 1)]
    u, v = (Fraction(x) for x in g[0])
    det = a * c - b * b
    np.testing.assert_allclose(f[0], root[0] * [float((c * u - b * v) / det), float((a * v - b * u) / det)], rtol=1e-8)


def test_tests_of_one_partition_are_coded_by_many_tasks(frame):
    rng = np.random.default_rng(42)
    train = frame(rng.normal(size=(300, 2)), np.arange(300) % 2)
    test = frame(rng.normal(size=(9000, 2)), np.zeros(9000), parts=1).drop("label")
    codes = huber_sparse_code(test, train)
    tasks = codes.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 18000 and len(tasks) >= 8 and max(r["count"] for r in tasks) <= 4500


def test_cells_do_not_grow_in_number_with_the_square_of_the_data(frame, monkeypatch):
    for times in (1, 10, 100):
        sizes, steps = {0: times << 20, 1: times << 21}, times << 20
        cell = coding._cell_size(sizes, steps, 8192, 96)
        columns, rows = coding._grid_shape(sizes, steps, cell)
        assert cell <= coding.MAX_CELL_BYTES and sum(columns.values()) * rows <= 96
    assert coding._cell_size({0: 1 << 40}, 1 << 40, 8192, 96) == coding.MAX_CELL_BYTES
    assert coding._cell_size({0: 1 << 20}, 1 << 20, 1 << 19, 96) == 1 << 19
    rng = np.random.default_rng(42)
    args = (frame(rng.normal(size=(400, 2)), np.zeros(400)).drop("label"), frame(rng.normal(size=(3000, 2)), np.arange(3000) % 2))
    seen = []
    grid = coding._grid
    monkeypatch.setattr(coding, "_grid", lambda pairs, parts, columns, rows: seen.append(sum(columns.values()) * rows) or grid(pairs, parts, columns, rows))
    a = huber_sparse_code(*args).toPandas().sort_values(["test_id", "class_idx"])
    b = huber_sparse_code(*args, max_dictionary_bytes=0, test_chunk_bytes=500, cell_bytes=300).toPandas()
    np.testing.assert_allclose(a.mae, b.sort_values(["test_id", "class_idx"]).mae, rtol=1e-9)
    assert 8 < max(seen) <= 64


def test_code_of_a_block_holds_two_matrices():
    rng = np.random.default_rng(42)
    rows, f, shift = rng.normal(size=(512, 8)), rng.normal(size=(512, 8)), rng.normal(size=512)
    tracemalloc.start()
    try:
        coding.code_parts(rows, [(f, shift)], 1.0, 0.9)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2.2 * 512 * 512 * 8


def test_boxes_without_a_whole_test_copy_no_steps(monkeypatch):
    rng = np.random.default_rng(42)
    rows, seen = rng.normal(size=(4000, 64)), []
    steps = [(rng.normal(size=(300, 64)), rng.normal(size=300))]
    lines = coding.RowBox.lines
    monkeypatch.setattr(coding.RowBox, "lines", lambda box, here, *a: seen.append(here) or lines(box, here, *a))
    coding.code_sums(coding.row_box(rows), steps, 1.0, 0.9)
    assert len(seen) > 8 and all(here is steps for here in seen)


def coding_peak(tests, rows):
    """Bytes that coding of 64 pixels holds at most, the dictionary counted."""
    rng = np.random.default_rng(42)
    B, A = rng.normal(size=(tests, 64)), rng.normal(size=(rows, 64))
    tracemalloc.start()
    try:
        coding.code_tests(B, A, coding.CodingParams())
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_pair_of_test_chunk_and_class():
    assert coding_peak(2048, 6000) < 160 << 20


def test_memory_grows_with_the_dictionary_alone():
    one, more_rows, more_tests = coding_peak(1024, 4000), coding_peak(1024, 12000), coding_peak(4096, 4000)
    assert more_rows - one < 3 * 8000 * 64 * 8
    assert more_tests - one < 6 * 3072 * 64 * 8
