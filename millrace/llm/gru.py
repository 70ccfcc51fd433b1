"""A gated recurrent network in numpy: steps, and backpropagation through time.

Gates use x / (1 + |x|) for tanh, and half of it plus a half for the logistic function:
cheap, smooth, and the same in training and scoring.
"""

from __future__ import annotations

import numpy as np

#: A gate input that keeps the state as it is: the update gate comes out as exactly 1.
KEEP = np.float32(1e30)


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def init(rng: np.random.Generator, hidden: int) -> np.ndarray:
    """Recurrent weights ``hidden x 3 hidden``: update, reset, candidate."""
    return (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)


def forward(gates: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States ``T+1 x B x H`` from gate inputs ``T x B x 3H``, and what ``backward`` needs."""
    steps, lanes, width = gates.shape
    h = width // 3
    states = np.zeros((steps + 1, lanes, h), np.float32)
    kept = []
    for t in range(steps):
        s = states[t]
        m = s @ u
        zr = 0.5 * soft(gates[t, :, : 2 * h] + m[:, : 2 * h]) + 0.5
        z, r = zr[:, :h], zr[:, h:]
        n = soft(gates[t, :, 2 * h :] + r * m[:, 2 * h :])
        states[t + 1] = n + z * (s - n)
        kept.append((z, r, n, m[:, 2 * h :]))
    return states, kept


def backward(dstates: np.ndarray, states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of gate inputs and recurrent weights, given those of ``states[1:]``."""
    steps, lanes, h = dstates.shape
    dgates, du, carry = np.empty((steps, lanes, 3 * h), np.float32), np.zeros_like(u), np.zeros((lanes, h), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, n, m = kept[t]
        s, d = states[t], dstates[t] + carry
        dn = d * (1 - z) * (1 - np.abs(n)) ** 2
        dz = d * (s - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * m * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dgates[t] = np.concatenate([dz, dr, dn], 1)
        dm = np.concatenate([dz, dr, dn * r], 1)
        du += s.T @ dm
        carry = d * z + dm @ u.T
    return dgates, du


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.w[k] -= (self.rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


class Steps:
    """Forward steps over many lanes, ``H x B`` arrays, all buffers reused."""

    def __init__(self, u: np.ndarray, lanes: int):
        self.h = u.shape[0]
        self.u = np.ascontiguousarray(u.T)
        self.gates, self.m = (np.empty((3 * self.h, lanes), np.float32) for _ in range(2))
        self.tmp = np.empty((2 * self.h, lanes), np.float32)
        self.state = np.zeros((self.h, lanes), np.float32)

    def step(self) -> np.ndarray:
        """The next state from ``self.gates`` (overwritten)."""
        h, g, m, tmp, s = self.h, self.gates, self.m, self.tmp, self.state
        np.dot(self.u, s, out=m)
        zr = g[: 2 * h]
        zr += m[: 2 * h]
        np.abs(zr, out=tmp)
        tmp += 1
        np.divide(zr, tmp, out=zr)
        zr *= 0.5
        zr += 0.5
        n, a = m[2 * h :], tmp[:h]
        n *= g[h : 2 * h]
        n += g[2 * h :]
        np.abs(n, out=a)
        a += 1
        np.divide(n, a, out=n)
        s -= n
        s *= g[:h]
        s += n
        return s
