"""Ridge logistic regression on the driver, for bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 1000


def fit_logistic(rows: Sequence[tuple[Sequence[int], bool]], width: int, ridge: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression on yes-or-no features, the last being the intercept (Newton's method)."""
    x = np.zeros((len(rows), width + 1), dtype=bool)
    x[:, -1] = True
    for i, (features, _) in enumerate(rows):
        x[i, features] = True
    y = np.array([r[1] for r in rows], dtype=float)
    w, penalty = np.zeros(width + 1), np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = -penalty * w, np.diag(penalty + 1e-9)
        for a in range(0, len(x), BLOCK):  # in blocks, so that only the bits are held whole
            part = x[a : a + BLOCK].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (y[a : a + BLOCK] - p)
            curve += (part * (p * (1 - p))[:, None]).T @ part
        w += np.clip(np.linalg.solve(curve, slope), -4, 4)
    return w


def scores(rows: Sequence[Sequence[int]], weights: np.ndarray) -> np.ndarray:
    """The log odds that weights give each row."""
    return np.array([float(weights[list(r)].sum() + weights[-1]) for r in rows])


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights [k, width + 1] of a multinomial logistic regression, the last column being intercepts (Newton's method, with
    steps halved while they make it worse)."""
    n, width = x.shape
    design = np.hstack([x, np.ones((n, 1))])
    truth = np.eye(k)[y]
    penalty = np.full((k, width + 1), ridge)
    penalty[:, -1] = 1e-3
    w = np.zeros((k, width + 1))

    def state(w):
        z = design @ w.T
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return p, -np.log(np.maximum((p * truth).sum(1), 1e-300)).sum() + (penalty * w * w).sum() / 2

    p, loss = state(w)
    for _ in range(rounds):
        slope = (p - truth).T @ design + penalty * w
        curve = np.zeros((k, width + 1, k, width + 1))
        for a in range(k):
            for b in range(k):
                curve[a, :, b, :] = (design * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ design
        full = curve.reshape(w.size, w.size) + np.diag(penalty.ravel())
        step, size = np.linalg.solve(full, slope.ravel()).reshape(w.shape), 1.0
        while size > 1e-4:
            q, now = state(w - size * step)
            if now <= loss:
                break
            size /= 2
        else:
            break
        done = loss - now < 1e-9 * max(1.0, loss)
        w, p, loss = w - size * step, q, now
        if done:
            break
    return w
