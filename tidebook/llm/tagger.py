"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy: training, and decoding of batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    symbols: int
    tags: int
    embedding: int = 12
    hidden: int = 16


def initial(shape: Shape, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    d, h = shape.embedding, shape.hidden
    weights = {"embed": rng.normal(0, 0.3, (shape.symbols, d))}
    for side in ("left", "right"):
        weights[f"{side}_in"] = rng.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h))
        weights[f"{side}_bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)  # input, forget, output gates, candidate
    weights["out"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, shape.tags))
    weights["out_bias"] = np.zeros(shape.tags)
    weights["first"] = np.zeros(shape.tags)
    weights["step"] = np.zeros((shape.tags, shape.tags))
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: np.ndarray, bias: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (length, rows, hidden) for inputs (length, rows, embedding), and what the way back needs."""
    length, rows, d = x.shape
    h = np.zeros((rows, w.shape[1] // 4))
    c = np.zeros_like(h)
    size = h.shape[1]
    from_input = x @ w[:d] + bias
    states, steps = np.empty((length, rows, size)), []
    for t in range(length):
        z = from_input[t] + h @ w[d:]
        gates = _sigmoid(z[:, : 3 * size])
        candidate = np.tanh(z[:, 3 * size :])
        before_h, before_c = h, c
        c = gates[:, size : 2 * size] * c + gates[:, :size] * candidate
        squashed = np.tanh(c)
        h = gates[:, 2 * size :] * squashed
        states[t] = h
        if keep:
            steps.append((before_h, before_c, gates, candidate, squashed))
    return states, steps


def _lstm_back(x, w, steps, up) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, weights and bias from those of the hidden states."""
    length, rows, d = x.shape
    size = w.shape[1] // 4
    dx, dw, db = np.empty_like(x), np.zeros_like(w), np.zeros(w.shape[1])
    dh, dc = np.zeros((rows, size)), np.zeros((rows, size))
    for t in range(length - 1, -1, -1):
        before_h, before_c, gates, candidate, squashed = steps[t]
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        dh = dh + up[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate(
            [dc * candidate * i * (1 - i), dc * before_c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - candidate**2)], axis=1
        )
        dx[t] = dz @ w[:d].T
        dw[:d] += x[t].T @ dz
        dw[d:] += before_h.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ w[d:].T, dc * f
    return dx, dw, db


def emissions(weights: Weights, symbols: np.ndarray, keep: bool = False):
    """Tag scores (length, rows, tags) of windows (rows, length)."""
    x = weights["embed"][symbols.T]
    left, left_steps = _lstm(x, weights["left_in"], weights["left_bias"], keep)
    right, right_steps = _lstm(x[::-1], weights["right_in"], weights["right_bias"], keep)
    both = np.concatenate([left, right[::-1]], axis=2)
    return both @ weights["out"] + weights["out_bias"], (x, both, left_steps, right_steps)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss(weights: Weights, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, Weights]:
    """Mean negative log-likelihood of the tag sequences and its gradient."""
    scores, (x, both, left_steps, right_steps) = emissions(weights, symbols, keep=True)
    length, rows, n = scores.shape
    step, first, y = weights["step"], weights["first"], tags.T
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = first + scores[0]
    for t in range(1, length):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + step, axis=1) + scores[t]
    for t in range(length - 2, -1, -1):
        behind[t] = _log_sum(step + (scores[t + 1] + behind[t + 1])[:, None, :], axis=2)
    total = _log_sum(ahead[-1], axis=1)
    at = np.arange(rows)
    gold = first[y[0]] + sum(scores[t, at, y[t]] for t in range(length)) + sum(step[y[t - 1], y[t]] for t in range(1, length))
    marginal = np.exp(ahead + behind - total[:, None])
    hot = np.eye(n)[y]
    d_scores = (marginal - hot) / rows
    d_step = np.zeros_like(step)
    for t in range(1, length):
        pair = ahead[t - 1][:, :, None] + step + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
        d_step += np.exp(pair).sum(axis=0) - hot[t - 1].T @ hot[t]
    grads = {"first": d_scores[0].sum(axis=0), "step": d_step / rows}
    grads["out"] = np.tensordot(both, d_scores, axes=([0, 1], [0, 1]))
    grads["out_bias"] = d_scores.sum(axis=(0, 1))
    d_both = d_scores @ weights["out"].T
    size = d_both.shape[2] // 2
    dx, grads["left_in"], grads["left_bias"] = _lstm_back(x, weights["left_in"], left_steps, d_both[:, :, :size])
    dr, grads["right_in"], grads["right_bias"] = _lstm_back(x[::-1], weights["right_in"], right_steps, d_both[::-1, :, size:])
    grads["embed"] = np.zeros_like(weights["embed"])
    np.add.at(grads["embed"], symbols.T, dx + dr[::-1])
    return float((total - gold).mean()), grads


def train(shape: Shape, symbols: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Weights:
    """Adam over shuffled batches of equally long windows; the same rows and seed give the same weights."""
    weights = initial(shape, seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    rng = np.random.default_rng(seed)
    order = np.zeros(0, dtype=np.int64)
    for turn in range(1, steps + 1):
        if len(order) < min(batch, len(symbols)):
            order = np.concatenate([order, rng.permutation(len(symbols))])
        rows, order = order[:batch], order[batch:]
        _, grads = loss(weights, symbols[rows], tags[rows])
        now = rate * (1.05 - turn / steps)
        size = np.sqrt(sum((g * g).sum() for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-12))
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights[k] = weights[k] - now * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return weights


def decode(weights: Weights, symbols: np.ndarray) -> np.ndarray:
    """The best tag sequence of every window: (rows, length)."""
    scores, _ = emissions(weights, symbols)
    length, rows, _ = scores.shape
    best = weights["first"] + scores[0]
    came = np.empty((length, *best.shape), dtype=np.int8)
    for t in range(1, length):
        ways = best[:, :, None] + weights["step"]
        came[t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[t]
    path = np.empty((length, rows), dtype=np.int8)
    path[-1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        path[t - 1] = came[t, np.arange(rows), path[t]]
    return path.T
