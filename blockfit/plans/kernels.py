"""NumPy steps on one chunk, one block or one model; Spark decides where they run."""

from __future__ import annotations

import numpy as np


def soft(a: np.ndarray, k: float | np.ndarray) -> np.ndarray:
    return np.maximum(a - k, 0) - np.maximum(-(a + k), 0)


def softmax_columns(m: np.ndarray) -> np.ndarray:
    """Softmax down the columns (classes x rows), in place; fast for few classes."""
    m -= m.max(axis=0)
    np.exp(m, out=m)
    m /= m.sum(axis=0)
    return m


def softmax(margins: np.ndarray) -> np.ndarray:
    """Softmax of every row."""
    return softmax_columns(np.array(margins.T, order="C", copy=True)).T


def softmax_residual(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``softmax(margins) - Y`` for class indices ``y``."""
    s = softmax(margins)
    s[np.arange(len(y)), y] -= 1.0
    return s


def softmax_terms(X: np.ndarray, y: np.ndarray, W: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient sum ``X'(softmax - Y)`` and the sum of the clipped log losses."""
    s = softmax(X @ W)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(s[rows, y], 1e-10)).sum()
    s[rows, y] -= 1.0
    return X.T @ s, float(loss)


def uncorrelated_coefficients(W: np.ndarray) -> np.ndarray:
    """``c_k``: the squared norms of all other classes, summed."""
    norms = (W**2).sum(axis=-2)
    return norms.sum(axis=-1, keepdims=True) - norms


class AdamMoments:
    """Adam with the step ``alpha * sqrt(1 - b2^t) / (1 - b1^t) * m / (sqrt(v) + eps)``."""

    def __init__(self, shape, alpha: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0
        self.alpha, self.beta1, self.beta2, self.eps = alpha, beta1, beta2, eps

    def _advance(self, g: np.ndarray) -> None:
        self.t += 1
        self.m *= self.beta1
        self.m += (1 - self.beta1) * g
        self.v *= self.beta2
        self.v += (1 - self.beta2) * np.square(g)

    def step(self, g: np.ndarray) -> np.ndarray:
        self._advance(g)
        rate = self.alpha * np.sqrt(1 - self.beta2**self.t) / (1 - self.beta1**self.t)
        return rate * self.m / (np.sqrt(self.v) + self.eps)

    def corrected_step(self, g: np.ndarray) -> np.ndarray:
        """The variant that corrects both moments before the root."""
        self._advance(g)
        m = self.m / (1 - self.beta1**self.t)
        v = self.v / (1 - self.beta2**self.t)
        return self.alpha * m / (np.sqrt(v) + self.eps)


def scaled_inverse(G: np.ndarray, s: float, r: float) -> np.ndarray:
    """``(s G + r I)^-1`` of a symmetric matrix or a stack of them; singular directions are dropped."""
    p = G.shape[-1]
    M = s * G + r * np.eye(p)
    if r > 0:
        return np.linalg.inv(M)
    return np.linalg.pinv(M, hermitian=True)


def _on_support(G: np.ndarray, a: np.ndarray, x: np.ndarray, k: float) -> np.ndarray | None:
    """The solution if its support and signs are those of ``x``, checked by the optimality conditions."""
    at = np.flatnonzero(x)
    signs = np.sign(x[at])
    try:
        values = np.linalg.solve(G[np.ix_(at, at)], a[at] - k * signs)
    except np.linalg.LinAlgError:
        return None
    out = np.zeros_like(x)
    out[at] = values
    left = np.abs(a - G @ out)
    left[at] = 0
    tol = 1e-9 * max(k, np.abs(a).max(initial=0.0), 1e-300)
    exact = np.abs(a[at] - G[at] @ out - k * signs).max(initial=0.0) <= tol
    return out if exact and (values * signs > 0).all() and (left <= k + tol).all() else None


def lasso_block(
    G: np.ndarray, a: np.ndarray, x: np.ndarray, k: float, tol: float = 1e-13, most_sweeps: int = 100_000
) -> np.ndarray:
    """Minimise ``k |x|_1 + x'Gx / 2 - a'x``, started at ``x``.

    Accelerated proximal steps on whole vectors find the support, on which the solution is a linear
    solve; the optimality conditions say whether it is right. Where they never do (columns that
    depend on each other), coordinate descent goes on to the tolerance, and says so if it cannot reach it.
    """
    x = x.copy()
    diagonal = np.diag(G)
    used = np.flatnonzero(diagonal > 0)
    x[diagonal <= 0] = 0.0
    if not len(used):
        return x
    step = 1.0 / max(np.linalg.eigvalsh(G)[-1], 1e-300)
    for _ in range(40):
        y, t = x, 1.0
        for _ in range(100):
            new = soft(y - step * (G @ y - a), step * k)
            if (y - new) @ (new - x) > 0:  # overshot: start the acceleration anew
                t = 1.0
            ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, x, t = new + (t - 1) / ahead * (new - x), new, ahead
        found = _on_support(G, a, x, k)
        if found is not None:
            return found
    Gx = G @ x
    for _ in range(most_sweeps):
        moved = 0.0
        for j in used:
            new = float(soft(np.float64(a[j] - Gx[j] + diagonal[j] * x[j]), k)) / diagonal[j]
            change = new - x[j]
            if change:
                Gx += G[:, j] * change
                x[j] = new
                moved = max(moved, abs(change))
        if moved <= tol * max(1.0, np.abs(x).max()):
            return x
    raise RuntimeError(f"the lasso of a block did not reach {tol} in {most_sweeps} sweeps")
