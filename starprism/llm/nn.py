"""A bidirectional gated recurrent network in numpy: forward, back-propagation through time, Adam.

Arrays are (steps, features, sequences), so that gates are contiguous. A mask of 0 leaves a state as it was, which
makes padded steps invisible to both directions.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.tanh(0.5 * x)
    y += 1
    y *= 0.5
    return y


def gru(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step. x: (T, 3h, n) input parts of the gates z, r and of the candidate; u: (3h, h)."""
    steps, three, n = x.shape
    h = three // 3
    state = np.zeros((h, n), np.float32)
    out = np.empty((steps, h, n), np.float32)
    for t in range(steps):
        a = u @ state
        gates = sigmoid(x[t, : 2 * h] + a[: 2 * h])
        z, r = gates[:h], gates[h:]
        c = np.tanh(x[t, 2 * h :] + r * a[2 * h :])
        step = z * mask[t] if mask is not None else z
        if keep is not None:
            keep.append((state, z, r, c, a[2 * h :], step))
        state = state + step * (c - state)
        out[t] = state
    return out


def gru_back(d_out: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs x and of u, given those of all states."""
    steps, h, n = d_out.shape
    dx = np.empty((steps, 3 * h, n), np.float32)
    du = np.zeros_like(u)
    carried = np.zeros((h, n), np.float32)
    for t in range(steps - 1, -1, -1):
        state, z, r, c, ac, step = keep[t]
        d = d_out[t] + carried
        dz = d * (c - state)
        if mask is not None:
            dz = dz * mask[t]
        dc = d * step * (1 - c * c)
        da = np.concatenate([dz * z * (1 - z), dc * ac * r * (1 - r), dc * r])
        dx[t, : 2 * h], dx[t, 2 * h :] = da[: 2 * h], dc
        du += da @ state.T
        carried = d * (1 - step) + u.T @ da
    return dx, du


def both_ways(x: np.ndarray, mask: np.ndarray | None, uf: np.ndarray, ub: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    """(T, 2h, n): forward and backward states. x: (T, 6h, n), the first half for the forward direction."""
    half = x.shape[1] // 2
    back = gru(x[::-1, half:], None if mask is None else mask[::-1], ub, keep and keep[1])
    return np.concatenate([gru(x[:, :half], mask, uf, keep and keep[0]), back[::-1]], axis=1)


def both_back(d: np.ndarray, mask: np.ndarray | None, uf: np.ndarray, ub: np.ndarray, keep: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = d.shape[1] // 2
    dxf, duf = gru_back(d[:, :h], mask, uf, keep[0])
    dxb, dub = gru_back(d[::-1, h:], None if mask is None else mask[::-1], ub, keep[1])
    return np.concatenate([dxf, dxb[::-1]], axis=1), duf, dub


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(size, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * np.sqrt(2 / (shape[0] + shape[-1]))).astype(np.float32)
