"""A small dense network (ReLU hidden layers, optional residual blocks) in numpy.

Used inside ``mapInPandas`` tasks: each Arrow batch runs the forward pass and
the backward pass for its own rows; Spark sums the per-partition gradients.
Parameters travel as one flat vector (broadcast to the tasks).
"""

from __future__ import annotations

import numpy as np


def shapes(n_in: int, hidden: list[int]) -> list[tuple[int, int]]:
    dims = [n_in] + list(hidden) + [1]
    return [(dims[i], dims[i + 1]) for i in range(len(dims) - 1)]


def n_params(n_in: int, hidden: list[int]) -> int:
    return sum(a * b + b for a, b in shapes(n_in, hidden))


def init(n_in: int, hidden: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(n_in, hidden):
        parts.append(rng.normal(0.0, np.sqrt(2.0 / a), size=(a, b)).reshape(-1))
        parts.append(np.zeros(b))
    return np.concatenate(parts)


def unpack(theta: np.ndarray, n_in: int, hidden: list[int]):
    out, k = [], 0
    for a, b in shapes(n_in, hidden):
        W = theta[k:k + a * b].reshape(a, b)
        k += a * b
        c = theta[k:k + b]
        k += b
        out.append((W, c))
    return out


def _uniform(keys: np.ndarray, units: int, layer: int, seed: int) -> np.ndarray:
    """rows x units draws in [0, 1) that depend only on the row's key, the layer, the unit and the seed."""
    stream = (np.uint64(seed & 0xFFFFFFFF) << np.uint64(32)) + np.arange(units, dtype=np.uint64) + np.uint64(layer << 20)
    x = keys.astype(np.int64).view(np.uint64)[:, None] ^ (stream * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def forward(theta, X, hidden, residual=False, dropout=0.0, keys=None, seed=0):
    """Outputs and the cache that ``backward`` needs.  With ``dropout`` a row's mask follows from its
    key and the seed, so two passes over the same row (scores, then gradients) share one mask."""
    layers = unpack(theta, X.shape[1], hidden)
    acts, masks, h = [X], [], X
    for i, (W, c) in enumerate(layers):
        z = h @ W + c
        if i == len(layers) - 1:
            return z[:, 0], (acts, masks)
        a = np.maximum(z, 0.0)
        if residual and a.shape == h.shape:
            a = a + h
        if dropout > 0 and keys is not None:
            m = (_uniform(keys, a.shape[1], i, seed) >= dropout) / (1.0 - dropout)
            a = a * m
        else:
            m = None
        masks.append((z, m))
        acts.append(a)
        h = a
    return h[:, 0], (acts, masks)


def backward(theta, X, hidden, cache, gout, residual=False, need_input_grad=False):
    """Gradient of sum_i gout_i * f(x_i) w.r.t. the parameters (flat) and the inputs."""
    layers = unpack(theta, X.shape[1], hidden)
    acts, masks = cache
    grads = [None] * len(layers)
    dout = gout[:, None]
    W, _ = layers[-1]
    grads[-1] = (acts[-1].T @ dout, dout.sum(0))
    dh = dout @ W.T  # d/d(input of the output layer)
    for i in reversed(range(len(layers) - 1)):
        z, m = masks[i]
        da = dh * m if m is not None else dh
        dz = da * (z > 0)
        W, _ = layers[i]
        grads[i] = (acts[i].T @ dz, dz.sum(0))
        dh = dz @ W.T
        if residual and acts[i + 1].shape == acts[i].shape:
            dh = dh + da
    return _flat(grads), (dh if need_input_grad else None)


def _flat(grads):
    return np.concatenate([np.concatenate([gW.reshape(-1), gc]) for gW, gc in grads])


class Adam:
    def __init__(self, lr=1e-3, b1=0.9, b2=0.999, eps=1e-8):
        self.lr, self.b1, self.b2, self.eps = lr, b1, b2, eps
        self.m = self.v = None
        self.t = 0

    def step(self, theta, g):
        if self.m is None:
            self.m = np.zeros_like(theta)
            self.v = np.zeros_like(theta)
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        mh = self.m / (1 - self.b1 ** self.t)
        vh = self.v / (1 - self.b2 ** self.t)
        return theta - self.lr * mh / (np.sqrt(vh) + self.eps)
