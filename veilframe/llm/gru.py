"""A bidirectional gated recurrent network in numpy, with backpropagation through time.

Sequences have a fixed length; both directions run as one stack of matrices
(axis 0), the second on reversed sequences. Inputs are given as the gates'
input terms, so that a table lookup can stand for the input weights.
"""

from __future__ import annotations

import numpy as np


def init_cell(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    scale = 1 / np.sqrt(hidden)
    return {"U": rng.uniform(-scale, scale, (2, hidden, 3 * hidden)).astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def forward(inputs, steps: int, U: np.ndarray, keep: bool = False):
    """Hidden states (2, steps, n, hidden), each direction in its own order of time.

    ``inputs(t)`` gives the (2, n, 3 * hidden) input terms of step t. With
    ``keep`` also what ``backward`` needs.
    """
    hidden = U.shape[1]
    states, tape, h = None, [], None
    for t in range(steps):
        x = inputs(t)
        if h is None:
            h = np.zeros((2, x.shape[1], hidden), np.float32)
            states = np.empty((2, steps, x.shape[1], hidden), np.float32)
        a = h @ U
        gates = _sigmoid(x[..., : 2 * hidden] + a[..., : 2 * hidden])
        z, r = gates[..., :hidden], gates[..., hidden:]
        inner = a[..., 2 * hidden :]
        n = np.tanh(x[..., 2 * hidden :] + r * inner)
        new = n + z * (h - n)
        if keep:
            tape.append((h, z, r, inner, n))
        h = new
        states[:, t] = h
    return (states, tape) if keep else states


def backward(tape: list, U: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input terms (2, steps, n, 3 * hidden) and of U."""
    steps, hidden = len(tape), U.shape[1]
    d_inputs = np.empty((*d_states.shape[:3], 3 * hidden), np.float32)
    d_U = np.zeros_like(U)
    d_h = np.zeros_like(d_states[:, 0])
    back = U.transpose(0, 2, 1)
    for t in reversed(range(steps)):
        h, z, r, inner, n = tape[t]
        d_h = d_h + d_states[:, t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_x = d_inputs[:, t]
        d_x[..., :hidden] = d_h * (h - n) * z * (1 - z)
        d_x[..., hidden : 2 * hidden] = d_n * inner * r * (1 - r)
        d_x[..., 2 * hidden :] = d_n
        d_a = d_x.copy()
        d_a[..., 2 * hidden :] *= r
        d_U += h.transpose(0, 2, 1) @ d_a
        d_h = d_h * z + d_a @ back
    return d_inputs, d_U


class Adam:
    """Adam steps on a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= ((rate or self.rate) * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x
