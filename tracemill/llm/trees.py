"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in a row; a leaf has feature -1. Children are at `left` and `left + 1`."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features; all rows walk all trees level by level."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, penalty: float = 1.0) -> Trees:
    """Boost logistic loss. signs: for each feature 1 (rising), -1 (falling) or 0; a split against its sign is not made.

    A child's values are kept within the bounds that the splits above set, so the whole tree is monotonic.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    raw = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + penalty), low, high))

    def best(at, g, h, low, high):
        found = (1e-6, None)
        total_g, total_h = g[at].sum(), h[at].sum()
        for f, sign in enumerate(signs):
            n = len(edges[f])
            if not n:
                continue
            c = codes[at, f]
            gl = np.cumsum(np.bincount(c, g[at], n + 1))[:-1]
            hl = np.cumsum(np.bincount(c, h[at], n + 1))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=n + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
            gain = -(gl * vl + 0.5 * (hl + penalty) * vl**2) - (gr * vr + 0.5 * (hr + penalty) * vr**2)
            v = np.clip(-total_g / (total_h + penalty), low, high)
            gain += total_g * v + 0.5 * (total_h + penalty) * v**2
            ok = (nl >= least) & (len(at) - nl >= least) & (sign * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > found[0]:
                found = (gain[k], (f, k, vl[k], vr[k]))
        return found[1]

    def grow(node: int, at: np.ndarray, g, h, low: float, high: float, level: int) -> None:
        split = best(at, g, h, low, high) if level < depth and len(at) >= 2 * least else None
        if split is None:
            nodes[node] = [-1, 0.0, 0, rate * leaf(g[at].sum(), h[at].sum(), low, high)]
            raw[at] += nodes[node][3]
            return
        f, k, vl, vr = split
        left = len(nodes)
        nodes.extend([[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]])
        nodes[node] = [f, float(edges[f][k]), left, 0.0]
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[f]]
        side = codes[at, f] <= k
        grow(left, at[side], g, h, *bounds[0], level + 1)
        grow(left + 1, at[~side], g, h, *bounds[1], level + 1)

    for _ in range(rounds if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        roots.append(len(nodes))
        nodes.append([-1, 0.0, 0, 0.0])
        grow(roots[-1], np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0)
    table = np.array(nodes, float).reshape(-1, 4)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3], np.array(roots, int), base, depth)
