"""A linear-chain conditional random field in numpy: padded batches, forward-backward training, Viterbi decoding."""

from __future__ import annotations

import zlib

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainField:
    """Scores of hashed string features for each label, and of each label after another."""

    def __init__(self, labels: tuple[str, ...], buckets: int = 4096):
        self.labels, self.buckets = labels, buckets
        self.weights = np.zeros((buckets, len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))
        self.memo: dict[tuple, np.ndarray] = {}

    def at(self, features: tuple[str, ...]) -> np.ndarray:
        found = self.memo.get(features)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[features] = np.array([zlib.crc32(f.encode()) % self.buckets for f in features])
        return found

    def padded(self, sequences: list[list[tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers as (sequence, step, feature), and lengths. Every step has equally many features."""
        lengths = np.array([len(s) for s in sequences])
        width = len(sequences[0][0])
        out = np.zeros((len(sequences), lengths.max(), width), int)
        for i, s in enumerate(sequences):
            for t, f in enumerate(s):
                out[i, t] = self.at(f)
        return out, lengths

    def fit(self, sequences: list, tags: list[list[int]], steps: int = 120, rate: float = 0.1, shrink: float = 1e-3) -> ChainField:
        """Full-batch Adam on the mean negative log-likelihood."""
        x, lengths = self.padded(sequences)
        n, longest, _ = x.shape
        k = len(self.labels)
        y = np.zeros((n, longest), int)
        for i, t in enumerate(tags):
            y[i, : len(t)] = t
        real = np.arange(longest)[None] < lengths[:, None]
        gold = np.zeros((n, longest, k))
        gold[np.arange(n)[:, None], np.arange(longest)[None], y] = 1
        gold *= real[..., None]
        both = real[:, 1:] & real[:, :-1]
        gold_moves = np.zeros((k, k))
        np.add.at(gold_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.weights, self.moves)]
        for step in range(1, steps + 1):
            unary = self.weights[x].sum(2)
            forward, backward = np.zeros_like(unary), np.zeros_like(unary)
            forward[:, 0] = unary[:, 0]
            for t in range(1, longest):
                new = unary[:, t] + _logsum(forward[:, t - 1][:, :, None] + self.moves[None], 1)
                forward[:, t] = np.where(real[:, t][:, None], new, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _logsum(self.moves[None] + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
                backward[:, t] = np.where(real[:, t + 1][:, None], new, 0)
            total = _logsum(forward[:, -1], 1)
            share = np.exp(np.where(real[..., None], forward + backward - total[:, None, None], -np.inf))
            pair = forward[:, :-1, :, None] + self.moves + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]
            moved = np.exp(np.where(both[..., None, None], pair, -np.inf)).sum((0, 1))
            slope = np.zeros_like(self.weights)
            for f in range(x.shape[2]):
                np.add.at(slope, x[:, :, f], share - gold)
            grads = [slope / n + shrink * self.weights, (moved - gold_moves) / n + shrink * self.moves]
            for p, g, (m, v) in zip((self.weights, self.moves), grads, state, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        """What one step's features say for each label."""
        return self.weights[self.at(features)].sum(0)

    def decode(self, sequences: list) -> list[np.ndarray]:
        """The best labels of each sequence of features."""
        return self.decode_scores([np.array([self.score(f) for f in s]).reshape(-1, len(self.labels)) for s in sequences])

    def decode_scores(self, scores: list[np.ndarray], most: int = 100_000) -> list[np.ndarray]:
        """The best labels of sequences with so much for each step and label (Viterbi), in batches of like length and at most `most` steps (or one sequence)."""
        out: list = [np.zeros(0, int)] * len(scores)
        order = sorted((i for i, s in enumerate(scores) if len(s)), key=lambda i: len(scores[i]))
        while order:
            count = max(1, min(len(order), most // len(scores[order[-1]])))
            own, order = order[-count:], order[:-count]
            lengths = np.array([len(scores[i]) for i in own])
            unary = np.zeros((len(own), lengths.max(), len(self.labels)))
            for n, i in enumerate(own):
                unary[n, : lengths[n]] = scores[i]
            best, back = unary[:, 0], np.zeros(unary.shape, np.int8)
            for t in range(1, unary.shape[1]):
                reach = best[:, :, None] + self.moves[None]
                back[:, t] = reach.argmax(1)
                best = np.where((t < lengths)[:, None], reach.max(1) + unary[:, t], best)
            tag = best.argmax(1)
            path = np.zeros(unary.shape[:2], int)
            rows = np.arange(len(own))
            for t in range(unary.shape[1] - 1, -1, -1):
                path[:, t] = tag
                tag = np.where(t < lengths, back[rows, t, tag], tag)
            for i, x, n in zip(own, path, lengths, strict=True):
                out[i] = x[:n]
        return out
