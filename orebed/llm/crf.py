"""Linear-chain conditional random field with two labels: training and Viterbi decoding in NumPy."""

from __future__ import annotations

import numpy as np


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.1, decay: float = 0.003) -> tuple[dict[str, tuple[float, float]], list[list[float]]]:
    """Maximum-likelihood weights of (feature lists, labels 0 or 1) sequences.

    Returns {feature: (weight of 0, weight of 1)} and the 2 x 2 transition weights.  Sequences are
    padded and the forward-backward recursions run over all of them at once."""
    names = sorted({f for x, _ in pages for block in x for f in block})
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(y) for _, y in pages)
    width = max(len(block) for x, _ in pages for block in x)
    pad = len(names)
    at = np.full((n, longest, width), pad, np.int64)
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), np.int64)
    for i, (x, y) in enumerate(pages):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
        for j, block in enumerate(x):
            at[i, j, : len(block)] = [index[f] for f in block]
    w, t = np.zeros((pad + 1, 2)), np.zeros((2, 2))
    target = np.eye(2)[gold] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(t), np.zeros_like(t)]]
    total = mask.sum()
    for step in range(1, steps + 1):
        score = w[at].sum(2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for j in range(1, longest):
            new = score[:, j] + np.logaddexp.reduce(forward[:, j - 1, :, None] + t, axis=1)
            forward[:, j] = np.where(mask[:, j, None], new, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(t + (score[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(mask[:, j + 1, None], new, 0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        p = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        pair = np.exp(forward[:, :-1, :, None] + t + (score + backward)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        d = p - target
        gw = np.zeros_like(w)
        np.add.at(gw, at.reshape(-1), np.repeat(d.reshape(-1, 2), width, axis=0))
        gw[pad] = 0
        for k, (param, g) in enumerate(((w, gw / total), (t, (pair.sum((0, 1)) - gold_pairs) / total))):
            g = g + decay / 10 * param
            m, v = moments[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[pad] = 0
    return {f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, t.tolist()


def viterbi(blocks: list[list[str]], model: tuple) -> list[int]:
    """The best labels of one sequence of feature lists."""
    weights, t = model
    t00, t01, t10, t11 = t[0][0], t[0][1], t[1][0], t[1][1]
    back, a, b = [], 0.0, 0.0
    none = (0.0, 0.0)
    for i, block in enumerate(blocks):
        s0 = s1 = 0.0
        for f in block:
            u, v = weights.get(f, none)
            s0 += u
            s1 += v
        if i:
            x, y = a + t00, b + t10
            p, q = a + t01, b + t11
            back.append((x < y, p < q))
            a, b = (y if x < y else x) + s0, (q if p < q else p) + s1
        else:
            a, b = s0, s1
    if not blocks:
        return []
    now = int(b > a)
    out = [now]
    for step in reversed(back):
        now = int(step[now])
        out.append(now)
    return out[::-1]
