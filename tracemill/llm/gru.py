"""A bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 12
LEAK = 0.15  # least share of a state that each word renews: what stands far before or behind a word leaves no trace in its state


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of those rows that `at` sends there."""
    return np.stack([np.bincount(at, x, n) for x in rows.T], 1).astype(np.float32)


class Network:
    """Inputs are a word's embedding and the mean embedding of its character trigrams."""

    def __init__(self, words: int, trigrams: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
        self.p = {"words": draw(words, WORD_DIM), "chars": draw(trigrams, CHAR_DIM), "v": draw(2 * HIDDEN), "u": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": draw(d, 3 * HIDDEN) * 2, f"u{way}": draw(HIDDEN, 3 * HIDDEN) * 2, f"g{way}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, word: np.ndarray, codes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A row for each distinct word; codes are all words' trigram numbers in a row, count of them each (one at least)."""
        mean = np.add.reduceat(self.p["chars"][codes], np.cumsum(count) - count, axis=0) / count[:, None]
        return np.concatenate([self.p["words"][word], mean], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The input part of all gates, for each distinct word once."""
        return {way: x @ self.p[f"w{way}"] + self.p[f"g{way}"] for way in "fb"}

    def run(self, gates: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, pool: np.ndarray | None = None, keep: bool = False):
        """Logits of windows; at: rows of gates by (window, step), real: which steps hold a word, pool: which of them the attention sees (all)."""
        n, length = at.shape
        states = np.zeros((length, n, 2 * HIDDEN), np.float32)
        kept: dict = {"f": [], "b": []}
        k = HIDDEN
        full = bool(real.all())
        for way, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h = np.zeros((n, k), np.float32)
            side = slice(0, k) if way == "f" else slice(k, 2 * k)
            u = self.p[f"u{way}"]
            for t in order:
                g, a = gates[way][at[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * k] + a[:, : 2 * k])
                z, r = LEAK + (1 - LEAK) * zr[:, :k], zr[:, k:]
                c = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
                new = h + z * (c - h)
                if not full:
                    new = np.where(real[:, t, None], new, h)
                if keep:
                    kept[way].append((t, h, z, r, c, a[:, 2 * k :]))
                h = states[t, :, side] = new
        e = np.where((real if pool is None else pool).T, states @ self.p["v"], -1e9)
        share = np.exp(e - e.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tn,tnk->nk", share, states)
        logits = pooled @ self.p["u"] + self.p["b"][0]
        return (logits, states, share, pooled, kept) if keep else logits

    def every(self, gates: dict[str, np.ndarray], at: np.ndarray, counts: np.ndarray, width: int, part: int = 1024, warm: int = 64) -> np.ndarray:
        """Logits of the windows of `width` words (a power of two) at each word, over texts of so many words in a row.

        A window that would leave its text ends with it. `at` holds each word's row of gates. States run through the whole
        text, once for all windows; after each `part` words they start anew, `warm` words ahead of (behind) the part. Parts
        of all texts step side by side, the longest first. Of a state only its weight for the attention and its
        share of the logit are kept; sums over windows by doubling then give all logits.
        """
        k, p = HIDDEN, self.p
        ends = np.cumsum(counts)
        begins = ends - counts
        each = -(-counts // part)
        text = np.repeat(np.arange(len(counts)), each)
        low = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * part
        high = np.minimum(low + part, ends[text])
        e, value = np.zeros(len(at), np.float32), np.zeros(len(at), np.float32)
        # as exponents: sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 1 - 2 / (1 + exp(2 x))
        scale = np.concatenate([np.full(2 * k, -1), np.full(k, 2)]).astype(np.float32)
        for way, side in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            if way == "f":
                start = np.maximum(low - warm, begins[text])
                skip, length, step = low - start, high - start, 1
            else:
                start = np.minimum(high + warm, ends[text]) - 1
                skip, length, step = start + 1 - high, start + 1 - low, -1
            order = np.argsort(-length, kind="stable")
            start, skip, length = start[order], skip[order], length[order]
            active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0)).tolist()
            u = np.concatenate([(p[f"u{way}"] * scale).T, p["v"][None, side], p["u"][None, side]])
            h, a = np.zeros((k, len(start)), np.float32), np.zeros((3 * k + 2, len(start)), np.float32)
            for t, m in enumerate(active):
                if m < h.shape[1]:
                    h, a = np.ascontiguousarray(h[:, :m]), np.ascontiguousarray(a[:, :m])
                    start, skip = start[:m], skip[:m]
                where = start + step * t
                g = np.multiply(gates[way][at[where]].T, scale[:, None], order="C")
                with np.errstate(over="ignore"):  # an infinite exponential gives the limit
                    zr = np.exp(np.add(g[: 2 * k], a[: 2 * k]))
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    zr[:k] *= 1 - LEAK
                    zr[:k] += LEAK
                    c = zr[k:] * a[2 * k : 3 * k]
                    c += g[2 * k :]
                    np.exp(c, out=c)
                c += 1
                np.divide(-2, c, out=c)
                c += 1
                c -= h
                c *= zr[:k]
                h += c
                np.matmul(u, h, out=a)
                if t < warm:
                    own = t >= skip
                    where = where[own]
                    e[where] += a[-2][own]
                    value[where] += a[-1][own]
                else:
                    e[where] += a[-2]
                    value[where] += a[-1]
        weight = np.exp(e.astype(float) - e.max(initial=0.0))
        sums = np.stack([weight * value, weight])
        left = np.repeat(ends, counts) - np.arange(len(at))  # words from here to the text's end
        have = 1
        while have < width:  # a window of twice the length is this one and the next, if the text has it
            more = np.zeros_like(sums)
            more[:, :-have] = sums[:, have:]
            sums += np.where(left > have, more, 0)
            have *= 2
        return sums[0] / sums[1] + p["b"][0]

    def slopes(self, x: np.ndarray, at: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray, pool: np.ndarray | None = None):
        """Gradients of the weighted logistic loss, and those of the rows of x."""
        logits, states, share, pooled, kept = self.run(self.projected(x), at, real, pool, True)
        out = {name: np.zeros_like(v) for name, v in self.p.items() if name not in ("words", "chars")}
        d = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) * weight / weight.sum()).astype(np.float32)
        out["b"][0], out["u"] = d.sum(), pooled.T @ d
        dp = d[:, None] * self.p["u"]
        da = np.einsum("nk,tnk->tn", dp, states)
        de = share * (da - (share * da).sum(0))
        out["v"] = np.einsum("tn,tnk->k", de, states)
        dstates = share[..., None] * dp + de[..., None] * self.p["v"]
        dsteps, k = np.zeros((*at.T.shape, x.shape[1]), np.float32), HIDDEN
        for way in "fb":
            dh = np.zeros((len(at), k), np.float32)
            u, w = self.p[f"u{way}"], self.p[f"w{way}"]
            for t, h, z, r, c, ac in reversed(kept[way]):
                dh = dh + dstates[t, :, :k] if way == "f" else dh + dstates[t, :, k:]
                live = np.where(real[:, t, None], dh, 0)
                dz, dc = live * (c - h) * (z - LEAK) * (1 - z) / (1 - LEAK), live * z * (1 - c * c)
                dr = dc * ac * r * (1 - r)
                dg, dn = np.concatenate([dz, dr, dc], 1), np.concatenate([dz, dr, dc * r], 1)
                out[f"u{way}"] += h.T @ dn
                out[f"w{way}"] += x[at[:, t]].T @ dg
                out[f"g{way}"] += dg.sum(0)
                dsteps[t] += dg @ w.T
                dh = live * (1 - z) + dn @ u.T + np.where(real[:, t, None], 0, dh)
        return out, summed(at.T.ravel(), dsteps.reshape(-1, x.shape[1]), len(x))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def move(self, slopes: dict[str, np.ndarray], shrink: float = 1e-5) -> None:
        self.step += 1
        for k, g in slopes.items():
            g = np.clip(g, -1, 1) + shrink * self.params[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)
