"""A linear hinge-loss model by dual coordinate descent, over sparse rows."""

from __future__ import annotations

import numpy as np


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: np.ndarray | float = 1.0, epochs: int = 12, seed: int = 5, tol: float = 1e-3, squared: bool = False) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise (|w|^2 + b^2) / 2 + sum c_i max(0, 1 - y_i (w x_i + b)).

    rows: (index, value) pairs; y: +1 or -1. One dual variable per row, between 0
    and c_i, visited in random order; each step is the exact minimum along it,
    clipped to that range. The bias is one more feature of value 1. squared: the
    square of each loss instead, which has no upper end of the range and adds
    1 / (2 c_i) to the diagonal.
    """
    n = len(rows)
    w, b = np.zeros(dims), 0.0
    c = np.broadcast_to(np.asarray(c, float), (n,))
    top = [np.inf] * n if squared else c.tolist()
    diag = (1 / (2 * c)).tolist() if squared else [0.0] * n
    q = [float(v @ v) + 1 + d for (_, v), d in zip(rows, diag, strict=True)]
    alpha, rng, sign = [0.0] * n, np.random.default_rng(seed), y.tolist()
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n).tolist():
            idx, val = rows[i]
            g = sign[i] * (float(w[idx] @ val) + b) - 1 + diag[i] * alpha[i]
            if g < 0 if alpha[i] <= 0 else g > 0 if alpha[i] >= top[i] else g:
                worst = max(worst, abs(g))
                new = min(max(alpha[i] - g / q[i], 0.0), top[i])
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                w[idx] += step * val
                b += step
        if worst < tol:
            break
    return w, b


def logistic_scale(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a margin + b))) fits y in {0, 1}: Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - t) * margin).sum() + 1e-6 * a, (p - t).sum()
        haa, hab, hbb = (s * margin * margin).sum() + 1e-6, (s * margin).sum(), s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)
